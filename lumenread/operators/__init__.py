"""Operators on DataFrames: the modules beside this one, and every registered query by its name.

    from lumenread import operators
    operators.run("spearman", {"fix": times}, {"user_id": "reader", "d": "rt", "w": "length", "i": "nth"})
    operators.run("cluster_bootstrap_diff", {"fix": times}, {"user_id": "reader", "d": "rt"}, draws=500)

Relations: fix (user_id, i, w, d, t, event_type: a log in order), nxt (fix with next_forward, see
gaze.with_next_forward), tok (doc_id, lang, pos, word), seq (tok with prev and next), sent (doc_id,
lang, sid, sentence), lex (word), dims (vec_id, label, k, x) and the tables by their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def names() -> list[str]:
    """The operators that run() knows."""
    from lumenread.plans import catalogue

    return sorted(name for module in catalogue.MODULES for name in module.QUERIES)


def relations(name: str) -> list[str]:
    """The relations that an operator reads."""
    from lumenread.functions.dialect import SPARK
    from lumenread.plans import catalogue

    query = next(m.QUERIES[name] for m in catalogue.MODULES if name in m.QUERIES)
    return query.used(query.text(SPARK))


def run(name: str, frames: Mapping[str, DataFrame], columns: Mapping[str, str] | None = None, **parameters) -> DataFrame:
    """An operator over frames of one's own; columns: the own column for each part that a relation's columns play."""
    from lumenread.plans import catalogue

    query = next((m.QUERIES[name] for m in catalogue.MODULES if name in m.QUERIES), None)
    if query is None:
        raise ValueError(f"no operator {name}")
    return query.on(frames, columns, **parameters)
