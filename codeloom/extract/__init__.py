"""Extraction of symbols, imports, references and routes from single source files."""
