"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table of a row per distinct text and batch, bucketed and sorted by digest. A batch of
new documents is digested and grouped; a sort-merge anti-join with the index tells which texts are
new; these and the sizes of what is known are appended.

A batch has a name and is decided once: its additions and its decisions are written beside the
index first, then the additions are appended. A batch that comes again, after a lost job or by
mistake, gets the same decisions, and only what an earlier try left undone is done. One writer at a
time is assumed.

Defined results: null text counts as empty; texts are equal after each run of white space
(space, tab to carriage return) became one space. Of equal texts in a batch the smallest doc_id
stays; of repeated rows of that doc_id one stays. A null doc_id sorts after all others. Over
batches the one that stayed first goes on staying, whatever ids come later: keep_id always names
it, and group_size counts the text's rows of all batches up to this one. An empty table gives an
empty result. Columns besides doc_id and text are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WHITE = r"[\x20\x09-\x0D]+"
#: A digest with more than this share of the rows is joined by broadcast, so fewer than HOT_SHARE digests are.
HOT_SHARE = 256
#: Batches that the query and the pipeline ingest a table in, by ascending doc_id.
BATCHES = 2


def digest(text: str = "text") -> Column:
    """Lowercase hex SHA-256 of the white-space-normalised text."""
    return F.sha2(F.regexp_replace(common.text_or_empty(text), WHITE, " ").cast("binary"), 256)


def digests_of(docs: DataFrame) -> DataFrame:
    """text_sha256, doc_id and n, the number of rows that have both."""
    return docs.select("doc_id", digest().alias("text_sha256")).groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))


class DigestIndex:
    """text_sha256, keep_id, group_size and batch of every text seen, as a bucketed and sorted table."""

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = 64):
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        """One row a digest: a batch adds a row for each of its digests, known or new, so sizes are sums."""
        return self.spark.table(self.table).groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def drop(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def staged(self, batch: str, part: str) -> str:
        return f"{self.path}-batches/{batch}/{part}"

    def has(self, batch: str) -> bool:
        return self.exists() and not self.spark.table(self.table).filter(F.col("batch") == batch).isEmpty()

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Decide every row of docs, append what the index lacks, return the decisions."""
        return self.ingest_digests(common.materialise(digests_of(docs), "digests"), batch)

    def ingest_digests(self, counted: DataFrame, batch: str | None = None) -> DataFrame:
        """As ingest, for rows of digests_of that can be read again."""
        batch = batch or common.fresh_name()
        added, decided = self.staged(batch, "added"), self.staged(batch, "decided")
        if not common.is_written(self.spark, decided):
            told = self.spark.read.parquet(added) if common.is_written(self.spark, added) else common.write(self.told_of(counted), added)
            common.write(decide(counted, told), decided)
        told = self.spark.read.parquet(added)
        if not self.has(batch):
            (told.select("text_sha256", "keep_id", F.col("n_rows").alias("group_size"), F.lit(batch).alias("batch"))
             .write.mode("append").format("parquet").option("path", self.path)
             .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table))
        return self.spark.read.parquet(decided)

    def told_of(self, counted: DataFrame) -> DataFrame:
        """Per digest of a batch: keep_id, group_size with all batches before, n_rows of this one, and whether it is new."""
        groups = counted.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("n_rows"))
        if not self.exists():
            return groups.select("text_sha256", "keep_id", F.col("n_rows").alias("group_size"), "n_rows", F.lit(True).alias("new"))
        groups = common.materialise(groups, "groups")
        fresh = groups.join(self.read().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        known = groups.drop("keep_id").join(self.read().hint("merge"), "text_sha256")
        return (fresh.select("text_sha256", "keep_id", F.col("n_rows").alias("group_size"), "n_rows", F.lit(True).alias("new"))
                .unionByName(known.select("text_sha256", "keep_id", (F.col("group_size") + F.col("n_rows")).alias("group_size"), "n_rows", F.lit(False).alias("new"))))


def decide(counted: DataFrame, told: DataFrame) -> DataFrame:
    """One row per input row from (text_sha256, doc_id, n) and what is told of each digest."""
    rows = counted.agg(F.sum("n")).first()[0] or 0
    # fewer than HOT_SHARE digests can have more than a HOT_SHARE-th of the rows
    is_hot = F.col("n_rows") > rows // HOT_SHARE
    hot, cold = F.broadcast(told.filter(is_hot)), told.filter(~is_hot)
    done = counted.join(hot, "text_sha256")
    rest = counted.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(cold.hint("merge"), "text_sha256")
    return (done.unionByName(rest)
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
            .select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    path = common.scratch_path(spark, "digest-index")
    common.scratch_path(spark, "", path + "-batches")
    return DigestIndex(spark, "digest_index_" + common.fresh_name(), path, buckets)


def decisions(docs: DataFrame) -> DataFrame:
    """A whole table through an index of its own, in BATCHES batches: a row per row of docs.

    Batches ascend by doc_id, nulls last, so what stays first is the smallest. In the end the
    index tells every row the size of its group over all batches.
    """
    spark = docs.sparkSession
    index = fresh_index(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = common.materialise(digests_of(docs), "digests")
    cuts = counted.approxQuantile("doc_id", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    nth = sum((F.when(F.col("doc_id") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    dealt = counted.withColumn("nth", F.when(F.col("doc_id").isNull(), BATCHES - 1).otherwise(nth))
    kept_ids = [index.ingest_digests(dealt.filter(F.col("nth") == k).drop("nth"), f"part-{k}") for k in range(BATCHES)]
    stayed = kept_ids[0]
    for more in kept_ids[1:]:
        stayed = stayed.unionByName(more)
    sizes = common.materialise(index.read(), "sizes")
    index.drop()
    rows = stayed.count()
    is_hot = F.col("group_size") > rows // HOT_SHARE
    sizes = sizes.select("text_sha256", F.col("group_size").cast("long").alias("group_size"))
    hot, cold = F.broadcast(sizes.filter(is_hot)), sizes.filter(~is_hot)
    stayed = stayed.drop("group_size")
    done = stayed.join(hot, "text_sha256")
    rest = stayed.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(cold.hint("merge"), "text_sha256")
    return done.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(common.read(spark, sf_dir, "documents"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    spark = docs.sparkSession
    told = decisions(docs)
    dropped = common.materialise(told.filter(~F.col("kept")).select("doc_id", "text_sha256").distinct(), "dropped")
    ids = docs.groupBy(F.col("doc_id").alias("id")).count().filter("count > 1").select(F.col("id").alias("doc_id"))
    ids = common.materialise(ids, "repeated-ids")
    if ids.isEmpty():
        return common.without(docs, dropped)
    # rows that share a doc_id are told apart by their texts; of equal ones the first stays
    once = common.without(docs, ids)
    shared = docs.join(ids.select(F.col("doc_id").alias("__id")), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    same = Window.partitionBy("doc_id", "__sha").orderBy("__sha")
    shared = shared.withColumn("__sha", digest()).withColumn("__nth", F.row_number().over(same))
    stay = told.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key"))
    shared = shared.filter("__nth = 1").join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__key")), "left_semi")
    return common.without(once, dropped).unionByName(shared.select(*[F.col(f"`{c}`") for c in docs.columns]))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
