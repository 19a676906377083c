"""Queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import (bpe, chat, decontam, jaccard, licenses, linededup, merkle, pii, quality, spelling,
               substrings, tokencount,
               urlfilter)

_MODULES = (substrings, tokencount, jaccard, chat, decontam, quality, bpe, pii, licenses, urlfilter, linededup,
            spelling, merkle)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
