"""Sub-word pieces learned from word counts, a model of pieces in running text, and what words cost by it.

Merges are learned in rounds. A round counts every two neighbouring pieces over all words at once
and merges the pairs that come first among all pairs that share a piece with them (by count, then
by name), so that no piece is in two of them: each round merges as many pairs as agree with one
another, and one aggregation serves them all. A round's words are written and read back. Pairs of a
round are no more than the pieces there are, that is bounded by the alphabet and the rounds, not by
the text, so they travel with the plan.

Text is read as words between white space, each with the blank before it. A text's context is the
text before it in its sequence unless that is empty or longer than a budget of words; without one
the first word has no blank and follows the start mark. Pieces cost -ln of their add-one share of
what followed the piece before. A piece belongs to the first word if it ends past the context, even
if it begins inside (the blank); a piece that is only the blank before a first word is the context's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenread.operators.depths import written
from lumenread.operators.transitions import HEAD, least_count
from lumenread.sources import tables

#: Pairs that are merged have to be seen so often; rounds, words of a context and slots of the queries.
SEEN, ROUNDS, BUDGET, SLOTS = 2, 8, 120, 20
START = "<s>"


def chosen_pairs(words: DataFrame) -> DataFrame:
    """left, right and n of the pairs of pieces (word, n, pieces) that come first among all that share a piece with them."""
    zipped = F.arrays_zip(F.slice("pieces", F.lit(1), F.size("pieces") - 1).alias("left"), F.slice("pieces", F.lit(2), F.size("pieces")).alias("right"))
    pairs = words.filter(F.size("pieces") > 1).select("n", F.explode(zipped).alias("z")).groupBy("z.left", "z.right").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)
    order = F.struct((-F.col("n")).alias("m"), "left", "right")
    either = pairs.select("*", F.explode(F.array("left", "right")).alias("piece"))
    first = either.groupBy("piece").agg(F.min(order).alias("best"))
    # chosen by both of its pieces: two rows of one pair, or one where both are the same
    agreed = first.filter((F.col("piece") == F.col("best.left")) | (F.col("piece") == F.col("best.right"))).groupBy("best").agg(F.count(F.lit(1)).alias("votes"))
    return agreed.filter((F.col("votes") == 2) | (F.col("best.left") == F.col("best.right"))).select("best.left", "best.right", (-F.col("best.m")).alias("n"))


def merged(pieces: list[str], pairs: dict[str, str]) -> list[str]:
    """Pieces in which the given pairs (left: right) are one, from the left."""
    out, at = [], 0
    while at < len(pieces):
        if at + 1 < len(pieces) and pairs.get(pieces[at]) == pieces[at + 1]:
            out.append(pieces[at] + pieces[at + 1])
            at += 2
        else:
            out.append(pieces[at])
            at += 1
    return out


def learn(counts: DataFrame, rounds: int = ROUNDS) -> tuple[list[dict[str, str]], DataFrame]:
    """Merges of each round (left: right) and the words (word, n, pieces) after them; it stops where nothing is left to merge."""
    words = written(counts.filter("word is not null and word <> ''").select("word", "n", F.split("word", "").alias("pieces")))
    found: list[dict[str, str]] = []
    for _ in range(rounds):
        pairs = {r["left"]: r["right"] for r in chosen_pairs(words).collect()}
        if not pairs:
            break
        found.append(pairs)
        apply = F.pandas_udf(lambda column, pairs=pairs: column.map(lambda p: merged(list(p), pairs)), "array<string>")
        words = written(words.select("word", "n", apply("pieces").alias("pieces")))
    return found, words


def encoded(words: F.Column, merges: list[dict[str, str]]) -> F.Column:
    """The pieces of words by learned merges, known or not; null and empty words have none."""

    @F.pandas_udf("array<string>")
    def of(batch: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}
        for word in batch.dropna().unique():
            pieces = list(word)
            for pairs in merges:
                pieces = merged(pieces, pairs)
            known[word] = pieces
        return batch.map(lambda w: known[w] if w is not None else [])

    return of(words)


def contexts(texts: DataFrame, key: list[str], order: str, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """key, order, words, whether the text has a context, and the last unit of that context."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = texts.select(*key, order, words.alias("words")).withColumn("size", F.size("words")).withColumn("end", F.get("words", F.col("size") - 1))
    earlier = lambda column, by=1: F.lag(column, by).over(Window.partitionBy(*key).orderBy(order))
    inside = lambda size: F.coalesce((size > 0) & (size <= budget), F.lit(False))
    rows = rows.withColumns({"context": inside(earlier("size")), "blank": (earlier("size") > 1) | inside(earlier("size", 2)), "end": earlier("end")})
    return rows.select(*key, order, "words", "context", F.when(F.col("context"), F.when(F.col("blank"), F.concat(F.lit(" "), "end")).otherwise(F.col("end"))).alias("end"))


def units_of(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, order, wnum, word, unit (the word with the blank before it, if any), told (the unit before it; null: none) and context, from rows of contexts."""
    each = rows.select(*key, order, "words", "context", "end", F.posexplode("words").alias("n0", "word"))
    with_blank = lambda n, word: F.when((n == 0) & ~F.col("context"), word).otherwise(F.concat(F.lit(" "), word))
    told = F.when(F.col("n0") == 0, F.col("end")).otherwise(with_blank(F.col("n0") - 1, F.get("words", F.col("n0") - 1)))
    return each.select(*key, order, (F.col("n0") + 1).alias("wnum"), "word", with_blank(F.col("n0"), F.col("word")).alias("unit"), told.alias("told"), "context")


def units(texts: DataFrame, key: list[str], order: str, text: str = "text", budget: int = BUDGET) -> DataFrame:
    """key, order, wnum, word, unit (the word with the blank before it, if any) and whether the text has a context."""
    return units_of(contexts(texts, key, order, text, budget), key, order).drop("told")


def word_costs(rows: DataFrame, words: DataFrame, key: list[str], order: str, head: int = HEAD) -> DataFrame:
    """key, order, wnum, word, pieces, inner (what its pieces but the first cost), cost (what the first costs) and lone (the first is a blank by itself).

    rows are units_of's, words what was learned from all of them. The pieces of a unit are the same wherever it is, and so
    is what they cost but for the first, which costs by the last piece of the unit before. So pairs are counted by unit and where units meet,
    and a row a word is joined, not a row a piece: with units that all tasks know, the most frequent ones, or by the two units.
    """
    words = words.select(F.col("word").alias("unit"), "n", "pieces")
    zipped = F.arrays_zip(F.slice("pieces", F.lit(1), F.size("pieces") - 1).alias("before"), F.slice("pieces", F.lit(2), F.size("pieces")).alias("piece"))
    inside = words.filter(F.size("pieces") > 1).select("unit", "n", F.explode(zipped).alias("z")).select("unit", "n", "z.before", "z.piece")
    ends = words.select("unit", F.get("pieces", F.lit(0)).alias("first"), F.element_at("pieces", -1).alias("last"))
    before = F.coalesce("last", F.lit(START)).alias("before")
    of_told = lambda of: of.select(F.col("unit").alias("told"), "last")
    met = rows.groupBy("told", "unit").agg(F.count(F.lit(1)).alias("n")).join(ends.select("unit", "first"), "unit").join(of_told(ends), "told", "left")
    pairs = written(inside.select("before", "piece", "n").unionByName(met.select(before, F.col("first").alias("piece"), "n")).groupBy("before", "piece").agg(F.sum("n").alias("c")))
    totals = pairs.groupBy("before").agg(F.sum("c").alias("t"))
    size = pairs.select("piece").distinct().agg(F.count(F.lit(1)).alias("v"))
    model = written(pairs.join(totals, "before").crossJoin(F.broadcast(size)).select("before", "piece", (-F.log((F.col("c") + 1.0) / (F.col("t") + F.col("v")))).alias("cost")))
    inner = inside.join(model, ["before", "piece"]).groupBy("unit").agg(F.sum("cost").alias("inner"))
    known = written(words.select("unit", "n", F.size("pieces").alias("pieces")).join(ends, "unit").join(inner, "unit", "left").select("unit", "n", "pieces", "first", "last", F.coalesce("inner", F.lit(0.0)).alias("inner")))
    often = known.filter(F.col("n") >= least_count(known.select("n"), head))
    own = lambda of: of.select("unit", "pieces", "first", "inner")
    asked = rows.select(*key, order, "wnum", "word", "unit", "told")
    near = asked.join(F.broadcast(own(often)), "unit", "left").join(F.broadcast(of_told(often)), "told", "left")
    missing = F.expr("first is null or (told is not null and last is null)")
    far = near.filter(missing).select(*asked.columns).join(own(known), "unit").join(of_told(known), "told", "left")
    both = near.filter(~missing).unionByName(far).select(*key, order, "wnum", "word", "pieces", "inner", before, F.col("first").alias("piece"))
    return both.join(model, ["before", "piece"]).select(*key, order, "wnum", "word", "pieces", "inner", "cost", (F.col("piece") == " ").alias("lone"))


def piece_costs(spoken: DataFrame, key: list[str], order: str) -> DataFrame:
    """spoken's pieces one by one (key, order, wnum, word, context, place, piece) and cost, each by the piece before it in its text or context."""
    rows = spoken.select(*key, order, "wnum", "word", "context", F.posexplode("pieces").alias("place", "piece"))
    told = F.lag("piece").over(Window.partitionBy(*key).orderBy(order, "wnum", "place"))
    rows = rows.withColumn("before", F.when((F.col("wnum") == 1) & (F.col("place") == 0) & ~F.col("context"), F.lit(START)).otherwise(told))
    pairs = rows.groupBy("before", "piece").agg(F.count(F.lit(1)).alias("c"))
    totals = rows.groupBy("before").agg(F.count(F.lit(1)).alias("t"))
    size = rows.select("piece").distinct().agg(F.count(F.lit(1)).alias("v"))
    model = pairs.join(totals, "before").crossJoin(F.broadcast(size)).select("before", "piece", (-F.log((F.col("c") + 1.0) / (F.col("t") + F.col("v")))).alias("cost"))
    return rows.join(model, ["before", "piece"])


def first_word_costs(costs: DataFrame, key: list[str], order: str) -> DataFrame:
    """What words cost, with a blank that is only the context's end left to the context."""
    own = ~((F.col("piece") == " ") & (F.col("wnum") == 1))
    return costs.groupBy(*key, order, "wnum", "word").agg(F.sum(F.when(own, 1).otherwise(0)).alias("pieces"), F.round(F.sum(F.when(own, F.col("cost")).otherwise(0.0)), 6).alias("surprisal"))


# ---------------------------------------------------------------- queries over conversations

KEYS, TURN = ["conv_id"], "turn"


def spoken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' units; turns of one number count once, by their least text."""
    turns = tables.read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return units_of(written(contexts(turns, KEYS, TURN)), KEYS, TURN)


def learned(rows: DataFrame) -> DataFrame:
    """Units of rows, how often they occur, and their pieces."""
    return learn(rows.groupBy(F.col("unit").alias("word")).agg(F.count(F.lit(1)).alias("n")))[1]


def spoken_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' words and their costs."""
    rows = spoken_turns(spark, sf_dir)
    return word_costs(rows, learned(rows), KEYS, TURN)


def subword_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that the words of conversations end up with: how many words hold each, and how often it is used."""
    words = learned(spoken_turns(spark, sf_dir))
    return words.select("n", F.explode("pieces").alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("uses"))


def subword_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by words, without a blank that is only the context's end."""
    outside = F.col("lone") & (F.col("wnum") == 1)
    return spoken_costs(spark, sf_dir).select(*KEYS, TURN, "wnum", "word", (F.col("pieces") - F.when(outside, 1).otherwise(0)).cast("long").alias("pieces"),
                                              F.round(F.col("inner") + F.when(outside, 0.0).otherwise(F.col("cost")), 6).alias("surprisal"))


def subword_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by words where a blank by itself is the word's that it follows; before a first word it is nobody's."""
    alone = F.struct((F.col("wnum") - 1).alias("wnum"), F.lit(1).alias("pieces"), F.col("cost").alias("surprisal"))
    rest = F.struct("wnum", (F.col("pieces") - F.when(F.col("lone"), 1).otherwise(0)).alias("pieces"), (F.col("inner") + F.when(F.col("lone"), 0.0).otherwise(F.col("cost"))).alias("surprisal"))
    parts = spoken_costs(spark, sf_dir).select(*KEYS, TURN, F.explode(F.when(F.col("lone") & (F.col("wnum") > 1), F.array(rest, alone)).otherwise(F.array(rest))).alias("p"))
    return parts.groupBy(*KEYS, TURN, F.col("p.wnum").alias("wnum")).agg(F.sum("p.pieces").alias("pieces"), F.round(F.sum("p.surprisal"), 6).alias("surprisal"))


def subword_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits by word, blanks with the words they begin, cut or padded with 0 to a number of slots."""
    rows = tables.read(spark, sf_dir, "conversations").select(*KEYS, TURN).distinct().select(*KEYS, TURN, F.explode(F.sequence(F.lit(1), F.lit(SLOTS))).alias("slot"))
    bits = spoken_costs(spark, sf_dir).filter(F.col("wnum") <= SLOTS).select(*KEYS, TURN, F.col("wnum").alias("slot"), ((F.col("inner") + F.col("cost")) / F.log(F.lit(2.0))).alias("bits"))
    return rows.join(bits, [*KEYS, TURN, "slot"], "left").select(*KEYS, TURN, "slot", F.round(F.coalesce("bits", F.lit(0.0)), 6).alias("bits"))


def _round_sql(r: int) -> str:
    """A round over single pieces in rows (unit, n, i, piece) instead of arrays."""
    return f"""x{r} as materialized (select *, lead(piece) over w as nxt, i - row_number() over (partition by unit, piece order by i) as run from p{r} window w as (partition by unit order by i)),
c{r} as (select piece as l, nxt as r, sum(n) as c from x{r} where nxt is not null group by piece, nxt having sum(n) >= {SEEN}),
b{r} as (select p, arg_min({{'l': l, 'r': r}}, (-c, l, r)) as best from (select l as p, l, r, c from c{r} union all select r as p, l, r, c from c{r}) group by p),
k{r} as materialized (select c.l, c.r from c{r} c join b{r} y on y.p = c.l and y.best.l = c.l and y.best.r = c.r join b{r} z on z.p = c.r and z.best.l = c.l and z.best.r = c.r),
s{r} as (select x.*, k.l is not null and (k.l <> k.r or row_number() over (partition by x.unit, x.piece, x.run order by x.i) % 2 = 1) as begins from x{r} x left join k{r} k on k.l = x.piece and k.r = x.nxt),
p{r + 1} as materialized (select unit, n, i, case when begins then piece || nxt else piece end as piece from (select *, coalesce(lag(begins) over (partition by unit order by i), false) as taken from s{r}) where not taken)"""


#: Written apart: pieces as rows.
PIECES_SQL = rf"""turns as (select conv_id, turn, list_filter(regexp_split_to_array(coalesce(min(text), ''), '\s+'), lambda w: w <> '') as words from conversations group by conv_id, turn),
ctx as (select *, coalesce(lag(len(words)) over (partition by conv_id order by turn), 0) between 1 and {BUDGET} as context from turns),
ws as (select conv_id, turn, context, unnest(range(1, len(words) + 1)) as wnum, unnest(words) as word from ctx),
us as materialized (select *, case when wnum = 1 and not context then word else ' ' || word end as unit from ws),
p0 as materialized (select unit, n, unnest(range(length(unit))) as i, unnest(string_split(unit, '')) as piece from (select unit, count(*) as n from us group by unit)),
{", ".join(_round_sql(r) for r in range(ROUNDS))}"""
COSTS_SQL = f"""{PIECES_SQL}, pieces as (select u.conv_id, u.turn, u.wnum, u.word, u.context, p.i, p.piece, min(p.i) over (partition by u.conv_id, u.turn, u.wnum) as i0 from us u join p{ROUNDS} p on p.unit = u.unit),
seq as materialized (select *, case when wnum = 1 and i = i0 and not context then '{START}' else lag(piece) over (partition by conv_id order by turn, wnum, i) end as before from pieces),
cost as (select s.*, -ln((count(*) over (partition by before, piece) + 1e0) / (count(*) over (partition by before) + (select count(distinct piece) from seq))) as cost from seq s)"""
QUERIES = {f.__name__: f for f in (subword_merges, subword_first, subword_last, subword_marked)}
ORACLE = {
    "subword_merges": f"with {PIECES_SQL} select piece, count(*) as places, cast(sum(n) as bigint) as uses from p{ROUNDS} group by piece",
    "subword_first": f"with {COSTS_SQL} select conv_id, turn, wnum, word, cast(sum(case when piece = ' ' and wnum = 1 then 0 else 1 end) as bigint) as pieces, round(sum(case when piece = ' ' and wnum = 1 then 0e0 else cost end), 6) as surprisal from cost group by conv_id, turn, wnum, word",
    "subword_last": f"with {COSTS_SQL}, m as (select conv_id, turn, case when piece = ' ' then wnum - 1 else wnum end as wnum, cost from cost) select conv_id, turn, wnum, count(*) as pieces, round(sum(cost), 6) as surprisal from m where wnum > 0 group by conv_id, turn, wnum",
    "subword_marked": f"with {COSTS_SQL}, slots as (select distinct conv_id, turn, slot from conversations cross join range(1, {SLOTS + 1}) t(slot)), w as (select conv_id, turn, wnum as slot, sum(cost) / ln(2e0) as bits from cost group by conv_id, turn, wnum) select conv_id, turn, cast(slot as int) as slot, round(coalesce(bits, 0), 6) as bits from slots left join w using (conv_id, turn, slot)"}
