"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from tallyroom.llm import grace, lines, merkle, mixing, orc_tokens, packing, phrases, quality, quotes, sharding, simhash, toxicity, warc

_PARTS = [quotes, orc_tokens, simhash, grace, sharding, lines, mixing, packing, quality, toxicity, merkle, warc, phrases]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
