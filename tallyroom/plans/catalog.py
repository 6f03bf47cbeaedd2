"""All named queries and their SQL twins."""

from __future__ import annotations

from tallyroom.plans import attendance, events, mail, plugins, questions

_AREAS = [attendance, mail, events, questions, plugins]

QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
