"""Readers for document files and writers for answers, manifests and blocks."""
