"""Registered queries over the given tables, each with its check in plain SQL where SQL can say it."""

from factloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "load_all"]


def load_all() -> None:
    from factloom.plans import (  # noqa: F401
        cells, coverage, extraction, ingest, reconciliation, relational, retrieval, streams, texts, verification,
    )
