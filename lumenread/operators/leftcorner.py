"""Left-corner parsing decisions of bracket trees, their conditional tables, and what words cost by them.

A left-corner parser keeps components: a category under way (A) and the one that it still awaits (B),
with TOP awaiting the root at first. A word either is what the last component awaits (F = 0), which
ends the component, or begins something new (F = 1). What is complete then is the left child of
some node: of the awaited one itself (J = 1: the component now awaits the node's right child), or of
one further down (J = 0: a new component of that node's category A, awaiting its right child B).
Nodes of more than two children count as if the rest after each child were a node of the same label;
a node with one child is one with it (the word's tag wins, else the upper label).

Decisions are (kind, predictor, response): F by depth and awaited category; P, the word's tag, by
these and F; W, the word, by its tag; J and A by depth, awaited and completed category; B by depth,
A and completed category. Depth is the number of components.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenread.operators import tagger, trees
from lumenread.operators.depths import written
from lumenread.operators.transitions import least_count
from lumenread.sources import tables

#: What a decision costs at most: this share of its predictor's decisions.
UNSEEN = 1e-6
#: Kinds whose costs a word adds up, before it and after it: fixed values.
BEFORE, AFTER = ("F", "P"), ("J", "A", "B")
#: Decisions whose costs every task knows, the most frequent ones at most.
HEAD = 100_000
#: Tokens of different shapes that a task remembers, and rows that it hands over at once.
HELD, ROWS = 500_000, 50_000
#: Sentences that are looked up at once.
ROWS_AT_ONCE = 2000
ASKED = pa.list_(pa.struct([("pred", pa.string()), ("resp", pa.string())]))
#: A clause of a shape: up to a comma, semicolon or colon.
CLAUSE = re.compile("[^,;:]*[,;:]|[^,;:]+")


class _View:
    """A node seen from one of its children on: what is left of it is a node of the same label."""

    __slots__ = ("label", "inside", "at")

    def __init__(self, node: tuple, at: int = 0):
        label, inside = node
        while not isinstance(inside, str) and len(inside) == 1:
            inner = inside[0]
            label, inside = inner if isinstance(inner[1], str) else (label, inner[1])
        self.label, self.inside, self.at = label, inside, at

    @property
    def word(self) -> str | None:
        return self.inside if isinstance(self.inside, str) else None

    def left(self) -> _View:
        return _View(self.inside[self.at])

    def right(self) -> _View:
        if self.at + 2 == len(self.inside):
            return _View(self.inside[-1])
        rest = _View((self.label, self.inside))
        rest.at = self.at + 1
        return rest


def decisions(node: tuple) -> Iterator[tuple[str, str, str]]:
    """The decisions of a tree's left-corner parse, in order; nodes without children have none."""
    if not node[1]:
        return
    # category, awaited node, and the way down from the awaited node below to where this component hangs
    stack: list[tuple[str, _View, list[_View]]] = [("TOP", _View(node), [])]
    while stack:
        category, awaited, hangs = stack[-1]
        depth, begun = len(stack), int(awaited.word is None)
        way = [awaited]
        while way[-1].word is None:
            if not way[-1].inside:
                return
            way.append(way[-1].left())
        leaf = way[-1]
        yield "F", f"F {depth} {awaited.label}", str(begun)
        yield "P", f"P {depth} {awaited.label} {begun}", leaf.label
        yield "W", f"W {leaf.label}", leaf.word
        if not begun:
            stack.pop()
            if not stack:
                return
            way = hangs
            category, awaited, hangs = stack[-1]
            depth = len(stack)
        done, above = way[-1], way[-2]
        joins = len(way) == 2
        yield "J", f"J {depth} {awaited.label} {done.label}", str(int(joins))
        if not joins:
            yield "A", f"A {depth} {awaited.label} {done.label}", above.label
            category = above.label
        right = above.right()
        yield "B", f"B {depth} {category} {done.label}", right.label
        if joins:
            stack[-1] = (category, right, hangs)
        else:
            stack.append((category, right, way[:-1]))


def decision_table(bracketed: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """key columns, step, kind, pred and resp of every decision of bracket trees; trees that don't parse have none."""

    @F.pandas_udf("array<struct<kind:string,pred:string,resp:string>>")
    def of(values: pd.Series) -> pd.Series:
        def one(value: str | None) -> list:
            node = trees.parse(value) if value else None
            return [{"kind": k, "pred": p, "resp": r} for k, p, r in decisions(node)] if node else []

        return values.map(one)

    found = bracketed.select(*key, F.posexplode(of(text)).alias("step", "d"))
    return found.select(*key, "step", "d.kind", "d.pred", "d.resp")


def conditional(steps: DataFrame, times: str | None = None) -> DataFrame:
    """pred, resp, n and p: each response's share of its predictor's decisions; times says how often a row counts."""
    number = F.count(F.lit(1)) if times is None else F.sum(times)
    counted = steps.groupBy("pred", "resp").agg(number.alias("n"))
    totals = steps.groupBy("pred").agg(number.alias("total"))
    return counted.join(totals, "pred").select("pred", "resp", "n", (F.col("n") / F.col("total")).alias("p"))


def surprisal(steps: DataFrame, table: DataFrame, *key: str, longest: int | None = None) -> DataFrame:
    """key columns, wnum, surprisal and unseen of words: what the decisions before a word (F, P) and right after it (J, A, B) cost.

    steps has key columns, step, kind, pred and resp; table pred, resp and p. A decision that the table lacks
    costs -ln 1e-6, which no decision exceeds. Trees of more than longest words are left out, if it is given.
    """
    told = steps.filter("kind <> 'W'").join(table.select("pred", "resp", "p"), ["pred", "resp"], "left").select(*key, "step", "kind", "p")
    words = steps.filter("kind = 'W'").select(*key, "step", "kind", F.lit(None).cast("double").alias("p"))
    order = Window.partitionBy(*key).orderBy("step")
    placed = told.unionByName(words).withColumn("seen", F.sum(F.when(F.col("kind") == "W", 1).otherwise(0)).over(order)).withColumn(
        "words", F.sum(F.when(F.col("kind") == "W", 1).otherwise(0)).over(Window.partitionBy(*key)))
    wnum = F.when(F.col("kind").isin(*BEFORE), F.col("seen") + 1).otherwise(F.col("seen"))
    cost = F.when(F.col("kind") != "W", -F.log(F.greatest(F.coalesce("p", F.lit(UNSEEN)), F.lit(UNSEEN)))).otherwise(0.0)
    unseen = F.when((F.col("kind") != "W") & F.col("p").isNull(), 1).otherwise(0)
    kept = placed if longest is None else placed.filter(F.col("words") <= longest)
    return kept.groupBy(*key, wnum.cast("int").alias("wnum")).agg(F.round(F.sum(cost), 5).alias("surprisal"), F.sum(unseen).alias("unseen"))


def lines_of(table: DataFrame) -> DataFrame:
    """A table as lines 'pred : resp = p'."""
    return table.select(F.concat_ws("", "pred", F.lit(" : "), "resp", F.lit(" = "), F.col("p").cast("string")).alias("line"))


def read_lines(lines: DataFrame) -> DataFrame:
    """A table from lines; others are passed over. The response is what stands before the last ' = ', without blanks."""
    pattern = r"^(.*) : (\S+) = ([0-9.eE+-]+)$"
    found = lines.filter(F.col("line").rlike(pattern))
    return found.select(*(F.regexp_extract("line", pattern, k).alias(n) for k, n in ((1, "pred"), (2, "resp"))), F.regexp_extract("line", pattern, 3).cast("double").alias("p"))


# ---------------------------------------------------------------- queries over the sentences of pages

def shape_steps(shapes: DataFrame) -> DataFrame:
    """Decisions of shapes (text: a tree without words, and other columns, which are kept)."""
    return decision_table(shapes, *shapes.columns)


def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of each sentence of the pages: its element and, as one character a token, _ for a word and marks as they are."""
    marks = F.array_join(F.transform("tokens", lambda x: F.when(x.isin(*".,;:!?"), x).otherwise("_")), "")
    return tables.marked_sentences(spark, sf_dir).select(*tagger.KEY, F.concat("element", F.lit(" "), marks).alias("shape"))


def shape_tree(shape: str) -> tuple:
    """The tree of a shape: tagger.page_trees' without words, parsed."""
    element, marks = shape.split(" ")
    return element, [("C", [(element if x == "_" else x, "_") for x in clause]) for clause in CLAUSE.findall(marks)]


def shape_words(shape: str) -> Iterator[list[tuple[str, str]]]:
    """For each word of a shape in order, the decisions before it and right after it, without the word itself."""
    word: list[tuple[str, str]] = []
    for kind, pred, resp in decisions(shape_tree(shape)):
        if kind == "F" and word:
            yield word
            word = []
        if kind != "W":
            word.append((pred, resp))
    yield word


def shape_parts(shape: str) -> Iterator[tuple[str, int, int]]:
    """Shapes of three clauses at most and places in them, whose words have the decisions of the shape's words in order.

    A clause's decisions depend on whether others come before and after it, and on what the last one is if that is the next.
    Before a clause any other does, and what comes after the next one doesn't matter.
    """
    element, marks = shape.split(" ")
    clauses = CLAUSE.findall(marks)
    for k, clause in enumerate(clauses):
        after = len(clauses) - k - 1
        if not after:
            yield (f"{element} ,{clause}", 1, len(clause) + 1) if k else (shape, 0, len(clause))
        elif after == 1:
            last = clauses[-1] if len(clauses[-1]) == 1 else "__"
            yield f"{element} {clause}{last}", 0, len(clause)
        else:
            yield f"{element} {clause},,", 0, len(clause)


class Pool:
    """Arrays by name and shape, one after another, so that many are gathered at once; equal parts of shapes are made once."""

    def __init__(self, make):
        self.make, self.parts = make, {}
        self.clear()

    def clear(self) -> None:
        self.size, self.place, self.starts, self.lengths, self.columns, self.whole = 0, {}, [], [], [], None
        if sum(map(len, self.parts)) > HELD:
            self.parts.clear()

    def add(self, shape: str) -> int:
        """The shape's number."""
        at = self.place.get(shape)
        if at is None:
            found = [tuple(x[lo:hi] for x in self.part(part)) for part, lo, hi in shape_parts(shape)]
            at = self.place[shape] = len(self.starts)
            self.starts.append(self.size)
            self.lengths.append(sum(len(x[0]) for x in found))
            self.size += self.lengths[-1]
            self.columns += found
            self.whole = None
        return at

    def part(self, part: str) -> tuple[np.ndarray, ...]:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = self.make(part)
        return found

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each row of shapes by their numbers: which of them it belongs to, its place in the shape from 1 on, and the arrays' values."""
        if self.whole is None:
            self.whole = np.array(self.starts), np.array(self.lengths), [np.concatenate(x) for x in zip(*self.columns, strict=True)]
            self.columns = [tuple(self.whole[2])]
        starts, lengths, columns = self.whole
        n = lengths[numbers]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(starts[numbers], n) + nth
        return np.repeat(np.arange(len(numbers)), n), (nth + 1).astype(np.int32), [x[at] for x in columns]


def count_decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: pred, resp and n of shapes; equal parts of shapes are gathered and parsed once, and what is held has a bound."""
    parts, size = Counter(), 0
    for batch in chain(batches, [None]):
        if batch:
            shapes = batch.column("shape").value_counts()
            for shape, times in zip(shapes.field("values").to_pylist(), shapes.field("counts").to_pylist(), strict=True):
                for part in shape_parts(shape):
                    size += 0 if part in parts else len(part[0])
                    parts[part] += times
            if size < HELD:
                continue
        counts = Counter()
        for (part, lo, hi), times in parts.items():
            for word in islice(shape_words(part), lo, hi):
                for decision in word:
                    counts[decision] += times
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["pred", "resp", "n"])
        parts.clear()
        size = 0


def tell_costs(known: dict[tuple[str, str], float], whole: bool, key: list[str]):
    """For mapInArrow: rows of words with what their known decisions cost, and unless known is the whole table the other decisions of a word.

    key's columns are kept.
    """

    def costs_of(part: str) -> tuple[np.ndarray, ...]:
        told = [[(known.get(d), d) for d in word] for word in shape_words(part)]
        cost = np.array([sum((x for x, _ in word if x is not None), 0.0) for word in told])
        missing = np.array([sum(x is None for x, _ in word) for word in told])
        if whole:
            return cost + missing * -math.log(UNSEEN), missing
        asked = np.empty(len(told), object)
        asked[:] = [[{"pred": p, "resp": r} for x, (p, r) in word if x is None] or None for word in told]
        return cost, np.zeros(len(told), np.int64), asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(costs_of)
        for batch in batches:
            lo = 0
            while lo < len(batch):
                if pool.size > HELD:
                    pool.clear()
                shapes = batch.column("shape").slice(lo, ROWS_AT_ONCE).dictionary_encode()
                numbers = np.array([pool.add(x) for x in shapes.dictionary.to_pylist()])[shapes.indices.to_numpy()]
                upto = np.cumsum(np.array(pool.lengths)[numbers])
                for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(upto // ROWS)) + 1):
                    row, nth, columns = pool.gathered(numbers[part])
                    index = pa.array(row + lo + part[0])
                    kinds = (pa.float64(), pa.int64(), ASKED)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in key), pa.array(nth), *(pa.array(x, t) for x, t in zip(columns, kinds))], names=[*key, "wnum", "surprisal", "unseen", "asked"][: len(key) + 1 + len(columns)])
                lo += len(numbers)

    return run


def left_corner_surprisal(spark: SparkSession, sf_dir: str, head: int = HEAD) -> DataFrame:
    """What each token of all pages costs, however long its sentence is, by the decisions of four fifths of them.

    The table may lack decisions, as the reference's does, which is counted on other texts than it is used on. Costs don't depend
    on the words. A task parses a part of a shape once while it remembers it, and only counts of decisions are shuffled. The most frequent decisions' costs go to all tasks; if there are more than head, others are joined to the words that they belong to.
    """
    sentences = written(page_shapes(spark, sf_dir))  # read twice, and small without words
    counts = sentences.filter(tagger.TRAIN).select("shape").mapInArrow(count_decisions, "pred string, resp string, n long").groupBy("pred", "resp").agg(F.sum("n").alias("n"))
    table = written(conditional(written(counts), "n").select("pred", "resp", "n", (-F.log(F.greatest("p", F.lit(UNSEEN)))).alias("cost")))
    whole = table.count() <= head
    often = table if whole else table.filter(F.col("n") >= least_count(table.select("n"), head))
    known = {(r["pred"], r["resp"]): r["cost"] for r in often.select("pred", "resp", "cost").collect()}
    told = sentences if whole else sentences.withColumn("row", F.monotonically_increasing_id())
    key = [k for k in told.columns if k != "shape"]
    kinds = ", ".join(f"{k} {t}" for k, t in told.dtypes if k in key)
    told = told.mapInArrow(tell_costs(known, whole, key), f"{kinds}, wnum int, surprisal double, unseen long" + ("" if whole else ", asked array<struct<pred:string,resp:string>>"))
    if not whole:
        told = written(told)
        asked = told.select(*key, "wnum", F.explode("asked").alias("d")).select(*key, "wnum", "d.pred", "d.resp").join(table.select("pred", "resp", "cost"), ["pred", "resp"], "left")
        asked = asked.select(*key, "wnum", F.coalesce("cost", F.lit(-math.log(UNSEEN))).alias("surprisal"), F.when(F.col("cost").isNull(), 1).otherwise(0).cast("long").alias("unseen"))
        sums = told.filter("asked is not null").drop("asked").unionByName(asked).groupBy(*key, "wnum").agg(F.sum("surprisal").alias("surprisal"), F.sum("unseen").alias("unseen"))
        told = told.filter("asked is null").drop("asked").unionByName(sums)
    return told.select(*tagger.KEY, "wnum", F.round("surprisal", 5).alias("surprisal"), "unseen")


def cpt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditional table of all pages, written as lines and read back; words from the leaves, other decisions from each shape of tree once."""
    shapes = tagger.page_trees(spark, sf_dir, words=False).groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    leaves = tagger.page_tags(spark, sf_dir).select(F.explode(F.arrays_zip(F.col("tags").alias("tag"), F.col("tokens").alias("token"))).alias("l"))
    words = leaves.groupBy(F.concat(F.lit("W "), "l.tag").alias("pred"), F.col("l.token").alias("resp")).agg(F.count(F.lit(1)).alias("times"))
    steps = written(shape_steps(shapes).filter("kind <> 'W'").groupBy("pred", "resp").agg(F.sum("times").alias("times")).unionByName(words))
    return read_lines(lines_of(conditional(steps, "times"))).withColumn("p", F.round("p", 9))


#: Written apart: the trees have two levels, so each token's decisions follow from its clause and its place in it.
STEPS_SQL = f"""d as (select page_id, block, part, nth, tag, token, element as el, coalesce(sum(case when token in (',', ';', ':') then 1 else 0 end) over (partition by page_id, block, part order by nth rows between unbounded preceding and 1 preceding), 0) as cl from ({tables.MARK_SQL})),
g as (select *, row_number() over c as i, count(*) over (partition by page_id, block, part, cl) as n, max(cl) over s + 1 as m, last_value(tag) over (partition by page_id, block, part, cl order by nth rows between unbounded preceding and unbounded following) as closing,
    count(*) over s as words from d window c as (partition by page_id, block, part, cl order by nth), s as (partition by page_id, block, part)),
h as (select *, cl + 1 = m as last_, case when m = 1 then el else 'C' end as own, case when cl + 2 < m then el else max(case when cl + 1 = m then case when n > 1 then 'C' else tag end end) over (partition by page_id, block, part) end as next_ from g),
k as (select *, case when not last_ and n > 1 and i > 1 then 2 else 1 end as dep, case when i = n and (last_ or n > 1) then 0 else 1 end as f, case when i + 1 < n then own else closing end as inner_ from h),
b as (select *, case when f = 0 then tag when last_ then own when n = 1 or i = 1 then el else 'C' end as aw from k),
q as (select *, 1 as nr, 'F' as kind, concat('F ', dep, ' ', aw) as pred, f::varchar as resp from b union all select *, 2, 'P', concat('P ', dep, ' ', aw, ' ', f), tag from b union all select *, 3, 'W', concat('W ', tag), token from b
    union all select *, 4, 'J', case when f = 0 then concat('J 1 ', el, ' C') else concat('J ', dep, ' ', aw, ' ', tag) end, case when f = 1 and not last_ and n > 1 and i = 1 then '0' else '1' end from b where not (last_ and i = n)
    union all select *, 5, 'A', concat('A 1 ', el, ' ', tag), 'C' from b where f = 1 and not last_ and n > 1 and i = 1
    union all select *, 6, 'B', case when f = 0 then 'B 1 TOP C' when last_ or n = 1 then concat('B 1 TOP ', tag) else concat('B ', dep, ' C ', tag) end, case when f = 0 or (not last_ and n = 1) then next_ else inner_ end from b where not (last_ and i = n))"""
SURPRISAL_SQL = f"""with {tagger.CRC_SQL}, {STEPS_SQL}, t as (select pred, resp, n / cast(sum(n) over (partition by pred) as double) as p from (select pred, resp, count(*) as n from q where page_id not in (select page_id from held) group by pred, resp))
select q.page_id, q.block, q.part, cast(q.nth as int) as wnum, round(sum(case when kind = 'W' then 0 else -ln(greatest(coalesce(p, 1e-6), 1e-6)) end), 5) as surprisal, cast(sum(case when kind <> 'W' and p is null then 1 else 0 end) as bigint) as unseen
from q left join t on t.pred = q.pred and t.resp = q.resp group by q.page_id, q.block, q.part, q.nth"""
LINES_SQL = f"with {STEPS_SQL} select pred, resp, round(n / cast(sum(n) over (partition by pred) as double), 9) as p from (select pred, resp, count(*) as n from q group by pred, resp)"

QUERIES = {"left_corner_surprisal": left_corner_surprisal, "cpt_lines": cpt_lines}
ORACLE = {"left_corner_surprisal": SURPRISAL_SQL, "cpt_lines": LINES_SQL}
