"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from . import alignment, curves, fingerprints, jaccard, licenses, mixing, pages, pieces, quality, repeats, toxicity, vectors, whitening

_MODULES = (alignment, curves, fingerprints, jaccard, licenses, mixing, pages, pieces, quality, repeats, toxicity, vectors, whitening)
QUERIES = {k: getattr(m, k) for m in _MODULES for k in vars(m) if k.startswith("op") and k[2:3].isdigit()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
