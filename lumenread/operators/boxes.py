"""Points and the boxes of a layout: the nearest line, then the box on it, by cells instead of all pairs.

A line is the middle height of some box of the layout. A point belongs to the nearest line (of two as
near the upper one) if it is at most band away, and there to the first box by index that it is in,
widened on both sides by half a gap. Lines are put into the cell of their height and its neighbours,
cells being band high, so a point finds all lines within band in its own cell; widened boxes are put into
all cells of their width. A cell's lines or boxes are one row, so points are joined twice and never grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenread.plans import extras
from lumenread.sources import tables


def assign_boxes(points: DataFrame, boxes: DataFrame, band: float, gap: float, width: float = 100.0) -> DataFrame:
    """points (layout, x, y and others) with line (its height), dist and box (its index); null where there is none.

    boxes are layout, index, x1, y1, x2, y2; width is that of a cell and changes nothing but the speed. Points
    without x or y or of a layout without boxes have no line; boxes without a corner aren't there.
    """
    whole = boxes.dropna(subset=["index", "x1", "y1", "x2", "y2"]).select("layout", "index", "x1", "x2", ((F.col("y1") + F.col("y2")) / 2).alias("line"))
    cell = lambda x, size: F.floor(x / size).cast("long")
    own = cell(F.col("line"), band)
    lines = whole.select("layout", "line").distinct().select("layout", "line", F.explode(F.array(own - 1, own, own + 1)).alias("cell_y")).groupBy("layout", "cell_y").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    spans = whole.select(
        "layout", "line", "index", (F.col("x1") - gap / 2).alias("from"), (F.col("x2") + gap / 2).alias("to")).filter(F.col("from") <= F.col("to")).select(
        "layout", "line", F.struct("index", "from", "to").alias("span"), F.explode(F.sequence(cell(F.col("from"), width), cell(F.col("to"), width))).alias("cell_x"))
    spans = spans.groupBy("layout", "line", "cell_x").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    near = points.withColumn("cell_y", cell(F.col("y"), band)).join(lines, ["layout", "cell_y"], "left").drop("cell_y")
    ranked = F.array_min(F.transform("lines", lambda c: F.struct(F.abs(F.col("y") - c).alias("dist"), c.alias("line"))))
    near = near.withColumn("hit", F.when(ranked["dist"] <= band, ranked)).drop("lines").withColumn("line", F.col("hit")["line"]).withColumn("dist", F.col("hit")["dist"]).drop("hit")
    found = near.withColumn("cell_x", cell(F.col("x"), width)).join(spans, ["layout", "line", "cell_x"], "left").drop("cell_x")
    inside = F.get(F.filter("spans", lambda s: (s["from"] <= F.col("x")) & (F.col("x") <= s["to"])), F.lit(0))["index"]
    return found.withColumn("box", inside).select(*points.columns, "line", "dist", "box")


#: Pixels of a letter, of a line, of a letter's height, and what a point may be off: sizes of the query's screen.
LETTER, LINE, HEIGHT, BAND, GAP = 10, 40, 30, 30.0, 10.0


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the words of items that are broken to lines."""
    words = extras.QUERIES["word_wrap"](spark, sf_dir)
    top = (F.col("line") - 1) * LINE
    return words.select(F.col("item_id").alias("layout"), F.col("id").alias("index"), (F.col("x") * LETTER).cast("double").alias("x1"), top.cast("double").alias("y1"), (F.col("stop") * LETTER).cast("double").alias("x2"), (top + HEIGHT).cast("double").alias("y2"))


def nearest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fixation's line and word on the screen of the item that its reader reads."""
    items = tables.read(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("items"))
    fix = tables.fixations(spark, sf_dir).crossJoin(F.broadcast(items))
    points = fix.select("user_id", "i", (F.col("user_id") % F.col("items")).alias("layout"), (F.col("w") * 37.0 + F.col("i") * 3.0).alias("x"), F.col("d").alias("y"))
    found = assign_boxes(points, word_boxes(spark, sf_dir), BAND, GAP)
    return found.select("user_id", "i", "layout", F.coalesce("line", F.lit(-1.0)).alias("line"), F.round(F.coalesce("dist", F.lit(-1.0)), 6).alias("dist"), F.coalesce("box", F.lit(-1)).cast("long").alias("box"))


#: Written apart: every point beside every line and box of its layout.
NEAREST_BOX_SQL = f"""with b as (select item_id as layout, id as idx, x * {LETTER} as x1, stop * {LETTER} as x2, (line - 1) * {LINE} + {HEIGHT} / 2e0 as mid from ({extras.QUERIES["word_wrap"].oracle()}) q),
p as (select user_id, i, user_id % (select count(*) from benchmark) as layout, w * 37e0 + i * 3e0 as x, d as y from ({tables.FIX_SQL}) f),
l as (select p.*, (select arg_min(mid, (abs(p.y - b.mid), b.mid)) from b where b.layout = p.layout) as mid from p),
n as (select user_id, i, layout, x, case when abs(y - mid) <= {BAND} then mid end as mid, abs(y - mid) as dist from l)
select user_id, i, layout, coalesce(mid, -1e0) as line, round(case when mid is null then -1 else dist end, 6) as dist, coalesce((select min(idx) from b where b.layout = n.layout and b.mid = n.mid and n.x between b.x1 - {GAP / 2} and b.x2 + {GAP / 2}), -1) as box from n"""
QUERIES = {"nearest_box": nearest_box}
ORACLE = {"nearest_box": NEAREST_BOX_SQL}
