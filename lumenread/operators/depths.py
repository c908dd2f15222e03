"""Depths of nodes in forests given by each node's head, by pointer doubling.

Every round replaces a node's pointer by its pointer's pointer and adds up the steps, so a chain of
ten million heads takes 24 joins and no recursion. A round's table is written to the shared folder
and read back: lineage stays short and a lost executor costs one round at most.

Rules: a head of 0 or null is the root's own mark, its depth is root_depth. A head that isn't there
counts as if it were a root: the node is one deeper. Heads that go round in a circle are cut where
the circle is entered from the smallest node that leads to it, as a walk from node to node in order
finds it: the last node before the circle closes counts one more than a root, and so on back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds after which a chain is longer than any count of rows.
ROUNDS = 62


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only on one machine without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import atexit
        import shutil
        import tempfile

        local = tempfile.mkdtemp(prefix="lumenread-tables-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, so that what made it isn't needed again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumenread-{uuid.uuid4().hex}-table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def climb(nodes: DataFrame) -> tuple[DataFrame, int]:
    """tree, node, top and steps of nodes (tree, node, up; up null: a top) by doubling, and how many nodes found no top.

    up has to be a node of the same tree or null. Nodes in or below a circle keep a pointer in up after
    as many steps as there are nodes; top is null then and up is a node of the circle.
    """
    bound, size = 1, nodes.count()
    # pointers that are still on their way, and what each node's pointer is by now
    state = written(nodes.select("tree", "node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    left = state.filter("up is not null").count()
    for _ in range(ROUNDS):
        if not left or bound > size:
            break
        seen = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up_"), F.col("top").alias("top_"), F.col("steps").alias("steps_"))
        moved = state.filter("up is not null").join(seen, ["tree", "up"]).select("tree", "node", F.col("up_").alias("up"), F.col("top_").alias("top"), (F.col("steps") + F.col("steps_")).alias("steps"))
        state = written(state.filter("up is null").unionByName(moved))
        bound, left = bound * 2, state.filter("up is not null").count()
    return state, left


def depths(heads: DataFrame, root_depth: int = 0) -> DataFrame:
    """tree, node and depth of heads (tree, node, head); of a node that is named twice the smallest head counts (root first)."""
    given = heads.filter("node is not null").groupBy("tree", "node").agg(F.min(F.coalesce("head", F.lit(0))).alias("head"))
    own = F.col("t.head") == 0
    there = given.select("tree", F.col("node").alias("head"), F.lit(True).alias("there"))
    # a head that isn't there makes a top that is one step deep already
    joined = given.alias("t").join(there.alias("h"), ["tree", "head"], "left")
    ups = written(joined.select("tree", "node", F.when(~own & F.col("there"), F.col("head")).alias("up"), F.when(own, 0).otherwise(1).cast("long").alias("base")))
    found, round_and_round = climb(ups.select("tree", "node", "up"))
    if round_and_round:
        ups = _without_circles(ups, found)
        found, round_and_round = climb(ups.select("tree", "node", "up"))
        assert not round_and_round
    bases = ups.filter("up is null").select("tree", F.col("node").alias("top"), "base")
    return found.join(bases, ["tree", "top"]).select("tree", "node", (F.col("steps") + F.col("base") + root_depth).alias("depth"))


def _without_circles(ups: DataFrame, found: DataFrame) -> DataFrame:
    """ups in which each circle is cut before the node where the smallest node that leads to it enters it."""
    stuck = found.filter("up is not null").select("tree", "node", "up")
    circle = written(stuck.select("tree", F.col("up").alias("node")).distinct())
    links = ups.join(circle, ["tree", "node"], "left_semi").select("tree", "node", F.col("up").alias("next"))
    # the smallest node of each circle names it: minima over twice as many links each round
    named = written(links.withColumn("name", F.col("node")))
    size, bound = named.count(), 1
    while bound <= size:
        ahead = named.select("tree", F.col("node").alias("next"), F.col("next").alias("next_"), F.col("name").alias("name_"))
        named = written(named.join(ahead, ["tree", "next"]).select("tree", "node", F.col("next_").alias("next"), F.least("name", "name_").alias("name")))
        bound *= 2
    # where each stuck node enters its circle: the circle's nodes are tops now
    roads = ups.join(stuck.select("tree", "node"), ["tree", "node"], "left_semi").join(circle.withColumn("on", F.lit(True)), ["tree", "node"], "left")
    entered, _ = climb(written(roads.select("tree", "node", F.when(F.col("on").isNull(), F.col("up")).alias("up"))))
    led = entered.join(named.select("tree", F.col("node").alias("top"), "name"), ["tree", "top"])
    entries = led.groupBy("tree", "name").agg(F.min_by("top", "node").alias("entry")).select("tree", F.col("entry").alias("up"), F.lit(True).alias("cut"))
    last = links.select("tree", "node", F.col("next").alias("up")).join(entries, ["tree", "up"]).select("tree", "node", "cut")
    cut = ups.join(last, ["tree", "node"], "left")
    return written(cut.select("tree", "node", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), F.when(F.col("cut"), 1).otherwise(F.col("base")).cast("long").alias("base")))


def depth_flags(rows: DataFrame, tree: str = "tree", node: str = "node", depth: str = "depth") -> DataFrame:
    """The eight flags of each node's change of depth from the node before it in its tree; a first node's are 0."""
    from pyspark.sql import Window

    order = Window.partitionBy(tree).orderBy(node)
    now, before = F.col(depth), F.lag(depth).over(order)
    told = {"h1": now != before, "h2": now > before, "h3": now < before, "h4": now == 0, "h5": F.lit(False), "h6": now - before > 1, "h7": before - now > 1, "h8": now == before}
    return rows.select(tree, node, depth, *(F.when(before.isNotNull() & flag, 1).otherwise(0).alias(name) for name, flag in told.items()))


# ---------------------------------------------------------------- queries

def item_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head for each word of each item: the next longer word, else the root; found in the item's own array of words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    sizes = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.transform(words, F.length).alias("sizes"))
    # a stack of the words still open, from the last to the first: the top that is longer is the head
    closing = lambda s, n: F.filter(s, lambda x: x["n"] > n)
    step = lambda s, k: F.struct(
        F.concat(F.array(F.struct(k.alias("k"), F.element_at("sizes", k).alias("n"))), closing(s["open"], F.element_at("sizes", k))).alias("open"),
        F.concat(s["heads"], F.array(F.coalesce(F.get(closing(s["open"], F.element_at("sizes", k)), F.lit(0))["k"], F.lit(0)))).alias("heads"))
    start = F.struct(F.expr("cast(array() as array<struct<k:int,n:int>>)").alias("open"), F.expr("cast(array() as array<int>)").alias("heads"))
    backwards = F.when(F.size("sizes") > 0, F.sequence(F.size("sizes"), F.lit(1), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)"))
    folded = sizes.select("item_id", F.reverse(F.aggregate(backwards, start, step)["heads"]).alias("heads"))
    return folded.select(F.col("item_id").alias("tree"), F.posexplode("heads").alias("n0", "head")).select("tree", (F.col("n0") + 1).alias("node"), "head")


def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, greatest and mean depth of each item's tree of next longer words; the root counts 1."""
    found = depths(item_heads(spark, sf_dir), 1)
    return found.groupBy(F.col("tree").alias("item_id")).agg(F.count(F.lit(1)).alias("words"), F.max("depth").alias("depth"), F.round(F.avg("depth"), 6).alias("mean_depth"))


#: Written apart: the heads of heads, level by level.
TREE_DEPTH_SQL = r"""
with recursive w as (select item_id, unnest(range(len(x))) + 1 as id, length(unnest(x)) as n from (select item_id, regexp_extract_all(lower(text), '\p{L}+') as x from benchmark)),
h as (select a.item_id, a.id, (select min(b.id) from w b where b.item_id = a.item_id and b.id > a.id and b.n > a.n) as head from w a),
t as (select item_id, id, 1 as depth from h where head is null union all select h.item_id, h.id, t.depth + 1 from t join h on h.item_id = t.item_id and h.head = t.id)
select item_id, count(*) as words, max(depth) as depth, round(avg(depth), 6) as mean_depth from t group by item_id
"""


def dep_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each item that have a head, and how far it is on average."""
    heads = item_heads(spark, sf_dir).filter("head > 0")
    return heads.groupBy(F.col("tree").alias("item_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("node") - F.col("head"))), 6).alias("mean_distance"))


DISTANCE_SQL = r"""
with w as (select item_id, unnest(range(len(x))) + 1 as id, length(unnest(x)) as n from (select item_id, regexp_extract_all(lower(text), '\p{L}+') as x from benchmark)),
h as (select a.item_id, a.id, min(b.id) as head from w a join w b on b.item_id = a.item_id and b.id > a.id and b.n > a.n group by a.item_id, a.id)
select item_id, count(*) as n, round(avg(head - id), 6) as mean_distance from h group by item_id
"""


def master_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by their distance from the record that they were merged into in the end; a client that is its own master is a root."""
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet")
    heads = clients.filter("client_id is not null").select(F.lit(0).alias("tree"), (F.col("client_id") + 1).alias("node"), F.when(F.col("master_id") == F.col("client_id"), 0).otherwise(F.col("master_id") + 1).alias("head"))
    return depths(heads).groupBy("depth").agg(F.count(F.lit(1)).alias("clients"), (F.min("node") - 1).alias("first_client"))


MASTER_DEPTHS_SQL = """
with recursive c as (select client_id as id, min(case when master_id = client_id or master_id is null then -1 else master_id end) as up from clients where client_id is not null group by client_id),
t as (select id, 0 as depth from c where up = -1 union all select c.id, 1 from c where up <> -1 and up not in (select id from c) union all select c.id, t.depth + 1 from t join c on c.up = t.id)
select depth, count(*) as clients, min(id) as first_client from t group by depth
"""


def page_depth_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each combination of the eight flags comes up from word to word of the items' trees."""
    flags = depth_flags(depths(item_heads(spark, sf_dir), 0))
    return flags.groupBy(*(f"h{k}" for k in range(1, 9))).agg(F.count(F.lit(1)).alias("n"))


DEPTH_FLAGS_SQL = r"""
with recursive w as (select item_id, unnest(range(len(x))) + 1 as id, length(unnest(x)) as n from (select item_id, regexp_extract_all(lower(text), '\p{L}+') as x from benchmark)),
h as (select a.item_id, a.id, (select min(b.id) from w b where b.item_id = a.item_id and b.id > a.id and b.n > a.n) as head from w a),
t as (select item_id, id, 0 as depth from h where head is null union all select h.item_id, h.id, t.depth + 1 from t join h on h.item_id = t.item_id and h.head = t.id),
p as (select depth as d, lag(depth) over (partition by item_id order by id) as b from t),
f as (select case when b is null then [0, 0, 0, 0, 0, 0, 0, 0] else [(d <> b)::int, (d > b)::int, (d < b)::int, (d = 0)::int, 0, (d > b + 1)::int, (b > d + 1)::int, (d = b)::int] end as f from p)
select f[1] as h1, f[2] as h2, f[3] as h3, f[4] as h4, f[5] as h5, f[6] as h6, f[7] as h7, f[8] as h8, count(*) as n from f group by all
"""
QUERIES = {"tree_depth": tree_depth, "dep_distance": dep_distance, "master_depths": master_depths, "tree_depth_flags": page_depth_flags}
ORACLE = {"tree_depth": TREE_DEPTH_SQL, "dep_distance": DISTANCE_SQL, "master_depths": MASTER_DEPTHS_SQL, "tree_depth_flags": DEPTH_FLAGS_SQL}
