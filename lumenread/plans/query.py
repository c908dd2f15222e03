"""Queries over named relations, run by Spark and spelled for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenread.functions.dialect import DUCK, SPARK, Dialect
from lumenread.sources import tables


KNOWN = {*tables.DERIVED, *tables.TABLES}


def played(needed: list[str], frames: Mapping[str, DataFrame], columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """The needed frames, with own columns under the names of the parts that they play."""
    missing = [n for n in needed if n not in frames]
    if missing:
        raise ValueError(f"relations without a frame: {', '.join(missing)}")
    return {n: frames[n].withColumnsRenamed({own: part for part, own in columns.items() if own in frames[n].columns and part not in frames[n].columns}) for n in needed}


@dataclass(frozen=True)
class SqlQuery:
    """A query that is SQL over relations written {name}."""

    text: Callable[[Dialect], str]

    def used(self, text: str) -> list[str]:
        return list(dict.fromkeys(n for n in re.findall(r"\{(\w+)\}", text) if n in KNOWN))

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        text = self.text(SPARK)
        frames = {name: tables.DERIVED[name](spark, sf_dir) if name in tables.DERIVED else tables.read(spark, sf_dir, name) for name in self.used(text)}
        text = text.replace("{", "{{").replace("}", "}}")  # patterns have braces as well
        for name in frames:
            text = text.replace(f"{{{{{name}}}}}", f"{{{name}}}")
        return spark.sql(text, **frames)

    def on(self, frames: Mapping[str, DataFrame], columns: Mapping[str, str] | None = None, **parameters) -> DataFrame:
        """The query over frames of one's own, by the relations' names.

        columns names the own column that plays each part, such as {"user_id": "reader", "d": "rt"};
        parts that come out carry the own name again. Parameters go to the query's text.
        """
        columns = dict(columns or {})
        text = self.text(SPARK, **parameters)
        cast = played(self.used(text), frames, columns)
        text = text.replace("{", "{{").replace("}", "}}")
        for name in cast:
            text = text.replace(f"{{{{{name}}}}}", f"{{{name}}}")
        spark = next(iter(cast.values())).sparkSession
        found = spark.sql(text, **cast)
        return found.withColumnsRenamed({part: own for part, own in columns.items() if part in found.columns})

    def oracle(self) -> str:
        text = self.text(DUCK)
        parts = [f"{name}_ as ({tables.DERIVED_SQL[name]})" for name in SqlQuery.used(self, text) if name in tables.DERIVED]
        body = re.sub(r"\{(\w+)\}", lambda m: f"{m[1]}_" if m[1] in tables.DERIVED else m[1] if m[1] in KNOWN else m[0], text).strip()
        if not parts:
            return body
        head = re.match(r"with\s+(recursive\s+)?", body, re.I)
        if head:
            return f"with {head[1] or ''}{', '.join(parts)}, {body[head.end():]}"
        return f"with {', '.join(parts)} {body}"


@dataclass(frozen=True)
class FrameQuery(SqlQuery):
    """A query that is made of frames; its SQL, written apart, is the oracle's."""

    made: Callable[..., DataFrame]
    needs: tuple[str, ...]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.made({name: tables.DERIVED[name](spark, sf_dir) if name in tables.DERIVED else tables.read(spark, sf_dir, name) for name in self.needs})

    def used(self, text: str) -> list[str]:
        """The relations of the SQL, which is the oracle's alone, or those of the frames."""
        return [n for n in self.needs] if text == self.text(SPARK) else super().used(text)

    def on(self, frames: Mapping[str, DataFrame], columns: Mapping[str, str] | None = None, **parameters) -> DataFrame:
        columns = dict(columns or {})
        found = self.made(played(list(self.needs), frames, columns), **parameters)
        return found.withColumnsRenamed({part: own for part, own in columns.items() if part in found.columns})
