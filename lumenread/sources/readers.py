"""Readers of the input formats: fixation logs, word indexes, dependency tables, JSON and survey files."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenread.sources import sheets


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file, line number and text of every line; lines of a file are in one partition."""
    whole = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", encoding).alias("text"))
    return whole.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))


def fields(text: str = "text") -> Column:
    return F.split(F.trim(text), r"\s+")


def fixation_log(spark: SparkSession, path: str) -> DataFrame:
    """file, wnum, fdur, fxno of a fixation log: the header and short lines are skipped, a file with a broken number goes as a whole."""
    rows = lines(spark, path, "ISO-8859-1").filter("line > 0").withColumn("f", fields()).filter(F.size("f") >= 11)
    number = lambda k: F.col("f")[k].try_cast("int")
    typed = rows.select("file", "line", number(6).alias("wnum"), number(7).alias("fdur"), number(10).alias("fxno"))
    bad = typed.filter("wnum is null or fdur is null or fxno is null").select("file").distinct()
    return typed.join(bad, "file", "left_anti").filter("wnum > 0 and fdur > 0 and fxno > 0")


def file_keys(rows: DataFrame, first: int = 1, last: int = 20) -> DataFrame:
    """Reader and article from names like sa01ma2p.dat: readers are numbered from 0 in order of their letters."""
    name = F.lower("file")
    rows = rows.withColumn("letter", F.regexp_extract(name, r"^s([a-z])\d\d", 1)).withColumn("article", F.regexp_extract(name, r"^s[a-z](\d\d)", 1).try_cast("int"))
    rows = rows.filter((F.col("letter") != "") & F.col("article").between(first, last))
    letters = rows.select("letter").distinct()  # at most one row a letter
    return rows.join(F.broadcast(letters.withColumn("reader", F.dense_rank().over(Window.orderBy("letter")) - 1)), "letter").drop("letter")


def word_index(spark: SparkSession, path: str) -> DataFrame:
    """file, word, page, line_no, wlen, wnum of a word index with at least 14 fields a line."""
    rows = lines(spark, path, "ISO-8859-1").withColumn("f", fields()).filter(F.size("f") >= 14)
    number = lambda k: F.col("f")[k].try_cast("int")
    return rows.select("file", F.col("f")[0].alias("word"), number(2).alias("page"), number(3).alias("line_no"), number(7).alias("wlen"), number(12).alias("wnum")).dropna()


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def sentence_map(spark: SparkSession, path: str) -> DataFrame:
    """text_id, wnum, sent_key and pos from dependency tables (word, pos, item, wnum, sentence, ...); the first row of a word wins."""
    rows = lines(spark, path).filter("trim(text) <> ''")
    tabbed = F.split("text", "\t")
    rows = rows.withColumn("f", F.when(F.size(tabbed) >= 5, tabbed).otherwise(fields()))
    typed = rows.select("file", "line", F.col("f")[1].alias("pos"), F.col("f")[2].try_cast("int").alias("text_id"), F.col("f")[3].try_cast("int").alias("wnum"), F.col("f")[4].try_cast("int").alias("sid")).dropna()
    first = first_of(typed, ["text_id", "wnum"], ["file", "line"])
    return first.select("text_id", "wnum", (F.col("text_id") * 10_000 + F.col("sid")).alias("sent_key"), F.coalesce("pos", F.lit("NN")).alias("pos"))


def acquisition_norms(rows: DataFrame, first: str, second: str | None, spread: list[str], word: str = "word", order: list[str] | None = None) -> DataFrame:
    """Mean (first, else second if there is one) and population spread of the known columns; words without a mean are dropped.

    Of repeated words the last by order wins; without an order, the last as rows are read, which holds for one unsplit file.
    """
    known = F.filter(F.array(*[F.col(c).cast("double") for c in spread]), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    deviation = F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) ** 2) / F.size(known))
    mean_of = F.coalesce(F.col(first), F.col(second)) if second else F.col(first)
    place = F.struct(*order) if order else F.monotonically_increasing_id()
    told = rows.withColumn("_n", place).select(
        F.lower(word).alias("word"), mean_of.cast("double").alias("aoa_mean"), F.when(F.size(known) >= 2, deviation).otherwise(0.0).alias("aoa_std"), "_n")
    return first_of(told.dropna(subset=["aoa_mean"]), ["word"], [F.desc("_n")]).drop("_n")


def json_objects(text: str) -> Iterator[str]:
    """Each of several JSON values written one after the other."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at < len(text):
            value, at = decoder.raw_decode(text, at)
            yield json.dumps(value, ensure_ascii=False)


def concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold pretty-printed JSON objects one after the other."""
    split = F.pandas_udf(lambda texts: texts.map(lambda t: list(json_objects(t))), "array<string>")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(split("value")).alias("one")).select(F.from_json("one", schema).alias("r")).select("r.*")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """file, sentence, id, form, upos, head of whole-numbered words."""
    rows = conllu_lines(spark, path)
    words = rows.filter((F.size("f") >= 7) & F.col("f")[0].rlike(r"^\d+$"))
    return words.select("file", "sentence", F.col("f")[0].cast("int").alias("id"), F.col("f")[1].alias("form"), F.col("f")[3].alias("upos"), F.col("f")[6].try_cast("int").alias("head"))


def conllu_lines(spark: SparkSession, path: str) -> DataFrame:
    order = Window.partitionBy("file").orderBy("line")
    return lines(spark, path).withColumn("sentence", F.sum(F.when(F.trim("text") == "", 1).otherwise(0)).over(order)).withColumn("f", F.split("text", "\t"))


def conllu_comments(spark: SparkSession, path: str) -> DataFrame:
    """file, sentence and a map of the attributes in its comment lines, '# name = value'."""
    found = conllu_lines(spark, path).select("file", "sentence", F.regexp_extract("text", r"^#\s*([^=]+?)\s*=\s*(.*)$", 1).alias("name"), F.regexp_extract("text", r"^#\s*([^=]+?)\s*=\s*(.*)$", 2).alias("value"))
    named = found.filter("name <> ''").dropDuplicates(["file", "sentence", "name"])
    return named.groupBy("file", "sentence").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attributes"))


def sentence_pairs(spark: SparkSession, path: str) -> DataFrame:
    """harder, simpler from tab-separated lines; empty and equal sides go."""
    rows = lines(spark, path).withColumn("f", F.split("text", "\t")).filter(F.size("f") >= 2)
    sides = rows.select(F.trim(F.col("f")[0]).alias("harder"), F.trim(F.col("f")[1]).alias("simpler"))
    return sides.filter("harder <> '' and simpler <> '' and harder <> simpler")


def survey(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Answers of a form whose columns are named 'item. question': keys, item, question, answer."""
    asked = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, [F.col(f"`{c}`") for c in asked], "column", "answer")
    return long.select(*keys, F.regexp_extract("column", r"^(\d+)\.", 1).try_cast("int").alias("item"), F.trim(F.regexp_replace("column", r"^\d+\.", "")).alias("question"), "answer").filter("item is not null")


def replies(rows: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """id and reply of tolerant 'S01 | reply' lines; the last of an id by order wins, else the last as rows are read."""
    found = rows.select((F.struct(*order) if order else F.monotonically_increasing_id()).alias("_n"), F.regexp_extract(text, r"^\W*(S\d+)\W*\|\s*(.+?)\s*$", 1).alias("id"), F.regexp_extract(text, r"^\W*(S\d+)\W*\|\s*(.+?)\s*$", 2).alias("reply"))
    return first_of(found.filter("id <> ''"), ["id"], [F.desc("_n")]).drop("_n")


def items(rows: DataFrame, regions: str = "regions") -> DataFrame:
    """Items with their regions, written with bars between, as trimmed parts; an empty part is an error."""
    parts = F.transform(F.split(regions, r"\|"), lambda x: F.trim(x))
    bad = F.exists(parts, lambda x: x == "")
    return rows.withColumn("parts", F.when(bad, F.raise_error(F.concat(F.lit("empty region in "), F.col(regions)))).otherwise(parts))


def script_items(text: Column, schema: str, start: str = r"=\s*") -> Column:
    """The first JSON array that a script assigns."""
    return F.from_json(F.regexp_extract(text, start + r"(\[[\s\S]*\])\s*;?", 1), schema)


def newest_sessions(rows: DataFrame, participant: str = "pid", started: str = "started", done: str = "completed") -> DataFrame:
    """Each participant's latest completed session."""
    return first_of(rows.filter(F.col(done)), [participant], [F.desc(started)])


def numbers(value: Column) -> Column:
    """Text as a struct of a whole number, a number or the text itself."""
    return F.struct(value.try_cast("bigint").alias("whole"), F.when(value.try_cast("bigint").isNull(), value.try_cast("double")).alias("number"), F.when(value.try_cast("double").isNull(), value).alias("text"))


def xml_words(spark: SparkSession, folder: str, glob: str = "*.xml") -> DataFrame:
    """file, place and lower-case word of the w elements of all files under a folder, words of letters only."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    whole = whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.regexp_extract_all("value", F.lit(r"<w[^>]*>([^<]*)</w>"), F.lit(1)).alias("words"))
    words = whole.select("file", F.posexplode("words").alias("place", "word")).withColumn("word", F.lower(F.trim("word")))
    return words.filter(F.col("word").rlike(r"^\p{L}+$"))


def pos_map(spark: SparkSession, path: str) -> DataFrame:
    """text_id, wnum and tag, a map of its own; the first row of a word wins and a missing tag is NN."""
    return sentence_map(spark, path).select("text_id", "wnum", F.when(F.trim("pos") == "", "NN").otherwise(F.col("pos")).alias("pos"))


def first_valid(candidates: DataFrame, key: str, order: list[str], content: str = "content", magic: bytes = b"%PDF", names: str | None = None) -> DataFrame:
    """The first candidate of each key whose content starts as it should and whose front matter names its class."""
    good = F.substring(content, 1, len(magic)) == F.lit(magic)
    if names is not None:
        good = good & F.contains(F.lower(F.col("front")), F.lower(F.col(names)))
    return first_of(candidates.filter(good), [key], order)


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, row, column and value of every filled cell of workbooks (Office Open XML), rows and columns from 1."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = [(p.rsplit("/", 1)[-1], *cell) for p, content in zip(frame["path"], frame["content"], strict=True) for cell in sheets.cells(content)]
            yield pd.DataFrame(rows, columns=["file", "sheet", "row", "column", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, sheet string, row int, column int, value string")


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member and content of the files in zip and tar archives whose names end so."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(p.rsplit("/", 1)[-1], *m) for m in sheets.members(content) if m[0].endswith(suffix)]
                yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def sessions_of(spark: SparkSession, path: str) -> DataFrame:
    """Each participant's latest completed session among the session.json files of archives."""
    told = zip_members(spark, path, "session.json").select("archive", "member", F.from_json(F.decode("content", "UTF-8"), "pid string, started string, completed boolean").alias("s"))
    return newest_sessions(told.select("archive", "member", "s.*"))


def parallel_lines(spark: SparkSession, sentences: str, numbers_: str) -> DataFrame:
    """line, sentence and word numbers of a file of sentences and a JSON array of arrays beside it; different lengths are an error."""
    left = lines(spark, sentences).filter("text <> ''").select(F.dense_rank().over(Window.orderBy("line")).alias("line"), F.col("text").alias("sentence"))
    whole = spark.read.text(numbers_, wholetext=True).select(F.from_json("value", "array<array<int>>").alias("all"))
    right = whole.select(F.posexplode("all").alias("at", "numbers")).select((F.col("at") + 1).alias("line"), "numbers")
    both = left.join(right, "line", "full")
    return both.withColumn("numbers", F.when(F.col("sentence").isNull() | F.col("numbers").isNull(), F.raise_error(F.lit("files of different lengths"))).otherwise(F.col("numbers")))


def ngrams(spark: SparkSession, path: str, order: int = 2) -> DataFrame:
    """Counts of n-grams written as CSV, words as text whatever they look like: 'null' and 'nan' are words."""
    names = ["word"] if order == 1 else [f"w{k}" for k in range(1, order + 1)]
    schema = ", ".join(f"{n} string" for n in names) + ", n long"
    return spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("nanValue", "\u0000").csv(path)


def corpus_lines(spark: SparkSession, path: str, pattern: str = r"\p{L}+") -> DataFrame:
    """file, line and the words of a script in the third of at least three tab-separated fields."""
    rows = lines(spark, path).withColumn("f", F.split("text", "\t")).filter(F.size("f") >= 3)
    return rows.select("file", "line", F.regexp_extract_all(F.col("f")[2], F.lit(pattern), F.lit(0)).alias("words"))


def write_bigrams(unigrams: DataFrame, bigrams: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Counts as two bucketed tables, so that lookups by (w1, w2) and by word join without a shuffle."""
    bigrams.write.mode("overwrite").option("path", f"{path}/bigrams").bucketBy(buckets, "w1", "w2").sortBy("w1", "w2").saveAsTable(f"{table}_bigrams")
    unigrams.write.mode("overwrite").option("path", f"{path}/unigrams").bucketBy(buckets, "word").sortBy("word").saveAsTable(f"{table}_unigrams")
