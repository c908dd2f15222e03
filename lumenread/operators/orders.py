"""An order of items for each participant that is the same whenever it is asked for.

The participant's code gives a seed (FNV-1a over its code points), the seed a stream of numbers
(mulberry32), and the stream a shuffle: from the last place to the second, the item there changes places
with one of those up to it. All three are public algorithms in 32-bit arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.sources import tables

WORD = 0xFFFFFFFF
#: Start and factor of the hash, step of the stream: fixed values.
FNV_START, FNV_FACTOR, STEP = 2166136261, 16777619, 0x6D2B79F5


def code_hash(code: str) -> int:
    h = FNV_START
    for c in code:
        h = (h ^ ord(c)) * FNV_FACTOR & WORD
    return h


def numbers(seed: int) -> Iterator[float]:
    """Numbers in [0, 1); the nth depends on seed + n * STEP only."""
    state = seed
    while True:
        state = state + STEP & WORD
        mixed = (state ^ state >> 15) * (state | 1) & WORD
        mixed ^= mixed + (mixed ^ mixed >> 7) * (mixed | 61) & WORD
        yield (mixed ^ mixed >> 14) / 4294967296


def dealt(items: Sequence, seed: int) -> list:
    out, drawn = list(items), numbers(seed)
    for last in range(len(out) - 1, 0, -1):
        other = int(next(drawn) * (last + 1))
        out[last], out[other] = out[other], out[last]
    return out


def participant_orders(rows: DataFrame, participant: str, item: str) -> DataFrame:
    """participant, item and place (from 1) of every item that a participant has, each once; null items aren't there.

    A participant's items are one list of the experiment, as many as a session can show.
    """
    kind = dict(rows.dtypes)[item]

    @F.pandas_udf(f"array<{kind}>")
    def order(codes: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([dealt(own, code_hash("" if code is None else code)) for code, own in zip(codes, lists, strict=True)])

    lists = rows.filter(F.col(item).isNotNull()).groupBy(participant).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return lists.select(participant, F.posexplode(order(F.col(participant).cast("string"), "items")).alias("n0", item)).select(participant, item, (F.col("n0") + 1).alias("place"))


def participant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events in the user's own order."""
    return participant_orders(tables.read(spark, sf_dir, "events"), "user_id", "event_type")


_MIX = "(xor({0}, {0} >> 15) * ({0} | 1)) % 4294967296"
#: Written apart: hash by reduction, the nth number from seed and n, one exchange a step.
ORDER_SQL = f"""
with recursive u as (select user_id, list_sort(list(distinct event_type)) as items from events where event_type is not null group by user_id),
h as (select user_id, items, list_reduce([{FNV_START}::hugeint] || list_transform(range(1, length(user_id::varchar) + 1), lambda i: ascii(substr(user_id::varchar, i, 1))::hugeint), lambda h, c: (xor(h, c) * {FNV_FACTOR}) % 4294967296) as seed from u),
s as (select user_id, seed, items, len(items) as pl, 1 as n from h union all select user_id, seed, list_transform(range(1, len(items) + 1), lambda k: case when k = pl then items[j] when k = j then items[pl] else items[k] end), pl - 1, n + 1 from (
    select *, floor((xor(t, t >> 14)) / 4294967296e0 * pl)::bigint + 1 as j from (select *, xor(m, (m + (xor(m, m >> 7) * (m | 61)) % 4294967296) % 4294967296) as t from (select *, {_MIX.format("a")} as m from (
    select *, (seed + n * {STEP}::hugeint) % 4294967296 as a from s where pl > 1) p) q) r) z)
select user_id, unnest(items) as event_type, cast(unnest(range(1, len(items) + 1)) as int) as place from s where pl <= 1
"""


def hash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the fold of a hundred that their checksum gives, and the FNV hash of their source."""
    from lumenread.operators import learn

    docs = tables.read(spark, sf_dir, "documents").select("doc_id", learn.crc_fold(F.col("doc_id"), 100).alias("fold"), learn.fnv1a(F.col("source")).alias("source_hash"))
    return docs.withColumn("split", F.when(F.col("fold") < 20, "test").otherwise("train"))


HASH_SQL = f"""with tab as (select list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
c as (select doc_id, source, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 100 as fold from documents cross join tab)
select doc_id, cast(fold as int) as fold, cast(list_reduce([{FNV_START}::bigint] || list_transform(range(1, length(source) + 1), lambda i: ascii(substr(source, i, 1))::bigint), lambda h, c: (xor(h, c) * {FNV_FACTOR}) % 4294967296) as bigint) as source_hash, case when fold < 20 then 'test' else 'train' end as split from c"""
QUERIES = {"participant_order": participant_order, "hash_codes": hash_codes}
ORACLE = {"participant_order": ORDER_SQL, "hash_codes": HASH_SQL}
