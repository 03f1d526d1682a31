"""All registered queries of this subpackage."""

from factloom.llm import (  # noqa: F401
    chatformat, decontamination, fingerprints, hardnegatives, jaccardjoin, licences, linededup, pagetext, pieces, prefixtrie, quality, sharding, trainingorder,
)
from factloom.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
