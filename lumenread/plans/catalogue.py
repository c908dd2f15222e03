"""The registered queries and their SQL."""

from __future__ import annotations

from lumenread.functions import landmarks, segment
from lumenread.operators import boxes, depths, forest, leftcorner, merged, orders, sliding, subwords, tagger
from lumenread.plans import extras, gaze, learning, statistics, text
from lumenread.streaming import queries as streams

MODULES = (gaze, text, statistics, learning, extras)
#: Modules whose queries are made of operators; their SQL is written apart.
BUILT = (depths, tagger, leftcorner, subwords, sliding, boxes, forest, segment, orders, merged, landmarks)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES | {name: frame for name, (frame, _) in module.FRAMES.items()}
    for module in BUILT:
        found |= module.QUERIES
    return found | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= {name: q.oracle() for name, q in module.QUERIES.items()}
        found |= {name: q.oracle() for name, (_, q) in module.FRAMES.items() if q is not None}
    for module in BUILT:
        found |= module.ORACLE
    return found
