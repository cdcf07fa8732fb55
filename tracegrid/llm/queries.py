"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, embeddings, jaccard, licenses, packing, quality, records, sharding, toxicity, urls

_MODULES = [licenses, quality, sharding, records, urls, jaccard, bpe, packing, embeddings, toxicity]


def queries() -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= module.SQL
    return out
