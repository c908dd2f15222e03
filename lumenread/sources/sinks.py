"""Writers of the output formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenread.operators import merged
from lumenread.sources.sheets import workbook

SKIPPED = -99


def word_ordered_lines(words: DataFrame, fixations: DataFrame) -> DataFrame:
    """A line for each fixation in word order, and one with SKIPPED for each word without any."""
    joined = words.join(fixations.select(F.col("wnum").alias("_w"), "fdur", "fxno"), F.col("wnum") == F.col("_w"), "left")
    line = F.format_string("%s %d %d %d", "word", "wnum", F.coalesce("fdur", F.lit(0)), F.coalesce("fxno", F.lit(SKIPPED)))
    return joined.select("wnum", F.coalesce("fxno", F.lit(SKIPPED)).alias("fxno"), line.alias("line")).orderBy("wnum", "fxno")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def answer_key(items: DataFrame, seed: str, item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Shuffled form and its key: place and side of each item by a documented hash.

    Places are counted within hash shares and the shares before, so that no task orders all items.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(item).cast("string")))
    shared = items.withColumn("_order", order).withColumn("_share", F.substring("_order", 1, 3))
    counted = shared.groupBy("_share").agg(F.count(F.lit(1)).alias("n"))  # at most 4096 rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_share").orderBy("_order", item))
    form = shared.withColumn("_within", within).join(F.broadcast(counted.select("_share", before.alias("_before"))), "_share")
    form = form.withColumn("place", (F.col("_before") + F.col("_within")).cast("int")).withColumn("a_is", F.when(F.substring("_order", 1, 1) < "8", "original").otherwise("simplified"))
    form = form.drop("_order", "_share", "_within", "_before")
    return form.drop("a_is"), form.select(item, "place", "a_is")


def event_lines(events: DataFrame, order: str = "t") -> DataFrame:
    """A session's events in their order, numbered: the event file."""
    numbered = events.withColumn("fxno", F.row_number().over(Window.partitionBy("reader").orderBy(order)))
    line = F.format_string("%-20s %4d %5d %4d", F.coalesce("word", F.lit(str(SKIPPED))), F.coalesce("wnum", F.lit(0)), F.coalesce(F.col("fdur").cast("int"), F.lit(0)), "fxno")
    return numbered.select("reader", "fxno", line.alias("line"))


def word_lines(words: DataFrame) -> DataFrame:
    """A line for each word of the layout: the word file."""
    line = F.format_string("%-20s %4d %4d %4d %4d", "word", "wnum", "line_no", "start_col", F.length("word"))
    return words.select("wnum", line.alias("line"))


def write_session(path: str, words: DataFrame, events: DataFrame) -> None:
    """The three files of a session, a folder each by reader: events in order, words in order with skipped ones, the layout."""
    seen = events.filter("wnum is not null").withColumn("fxno", F.row_number().over(Window.partitionBy("reader").orderBy("t")))
    readers = events.select("reader").distinct()
    grid = readers.crossJoin(F.broadcast(words.select("wnum", "word")))  # a session's layout is one text
    joined = grid.join(seen.select("reader", "wnum", "fdur", "fxno"), ["reader", "wnum"], "left")
    line = F.format_string("%-20s %4d %5d %4d", F.when(F.col("fxno").isNull(), F.lit(str(SKIPPED))).otherwise(F.col("word")), "wnum", F.coalesce(F.col("fdur").cast("int"), F.lit(0)), F.coalesce("fxno", F.lit(0)))
    in_order = joined.select("reader", "wnum", F.coalesce("fxno", F.lit(0)).alias("n"), line.alias("line")).repartition("reader").sortWithinPartitions("reader", "wnum", "n")
    for name, frame in (("events", event_lines(events).repartition("reader").sortWithinPartitions("reader", "fxno")), ("words", in_order)):
        frame.select("reader", "line").write.mode("overwrite").partitionBy("reader").text(f"{path}/{name}")
    word_lines(words).orderBy("wnum").select("line").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def write_corpus(path: str, words: DataFrame, sentences: DataFrame, texts: DataFrame) -> None:
    """A merged corpus: each reader's words, participants, word and sentence means of what is kept, tokenised texts (sid, sentence).

    words and sentences are as merged.word_means and merged.sentence_means take them.
    """
    words.write.mode("overwrite").partitionBy("reader").parquet(f"{path}/readers")
    merged.participants(sentences).write.mode("overwrite").parquet(f"{path}/participants")
    merged.word_means(words).write.mode("overwrite").parquet(f"{path}/word_means")
    merged.sentence_means(sentences, words).write.mode("overwrite").parquet(f"{path}/sentence_means")
    spaced = F.trim(F.regexp_replace(F.regexp_replace("sentence", r"([.,;:!?])", " $1 "), r"\s+", " "))
    texts.select("sid", spaced.alias("tokens")).write.mode("overwrite").parquet(f"{path}/sentences")


def write_workbook(path: str, sheets: dict[str, DataFrame], most: int = 1_000_000) -> None:
    """Frames as the sheets of one workbook with a header row; a frame that a sheet can't hold is an error."""
    rows = {}
    for name, frame in sheets.items():
        found = frame.limit(most + 1).collect()  # a sheet holds about a million rows
        if len(found) > most:
            raise ValueError(f"{name} has more than {most} rows")
        rows[name] = [frame.columns, *[list(r) for r in found]]
    with open(path, "wb") as file:
        file.write(workbook(rows))


def write_results(path: str, results: DataFrame, calibration: DataFrame, participants: DataFrame) -> None:
    """Results, and the calibration rows of the participants among them only."""
    results.write.mode("overwrite").parquet(f"{path}/results")
    calibration.join(participants.select("pid").distinct(), "pid", "left_semi").write.mode("overwrite").parquet(f"{path}/calibration")


def markdown(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables; of a longer one its first rows by all columns, and how many there are."""
    out = [f"# {title}"]
    for name, frame in tables.items():
        rows = frame.orderBy(*frame.columns).limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + "-|" * len(frame.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            out += ["", f"{frame.count()} rows, the first {most} shown."]
    return "\n".join(out) + "\n"
