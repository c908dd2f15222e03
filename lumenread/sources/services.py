"""Services as data sources: paged readers, questions to models and sheets that are appended to, each safe to repeat.

A page and an answer are kept as a file of their own in a folder that the cluster shares, put in place
whole by a rename, as soon as they are there. A task that is run again finds what the lost one had got and
asks only for the rest. A sheet's rows are written to files that nobody reads until the batch is
committed by one manifest; a batch that comes again is committed once, and an aborted one leaves nothing.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Letters of a sheet's cell, and what follows a cell that was longer: fixed values.
CELL, CUT = 49_000, "…TRUNCATED"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_kept(folder: str, name: str) -> str | None:
    """A kept text, or nothing."""
    system, path = store(folder)
    at = posixpath.join(path, name)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_stream(at) as file:
        return file.read().decode()


def keep(folder: str, name: str, text: str) -> None:
    """Keep a text under a name; it is there as a whole or not at all."""
    system, path = store(folder)
    system.create_dir(posixpath.join(path, "_new"), recursive=True)
    new = posixpath.join(path, "_new", uuid.uuid4().hex)
    with system.open_output_stream(new) as file:
        file.write(text.encode())
    system.move(new, posixpath.join(path, name))


# ---------------------------------------------------------------- pages

class Page(InputPartition):
    """One page of a service."""


def paged(spark: SparkSession, fetch: Callable[[int], str | None], total: Callable[[str], int], rows: Callable[[str], Iterator[tuple]], schema: str, cache: str) -> DataFrame:
    """Rows of a paged service, a task for each page.

    fetch gives a page's body (nothing: past the end), total how many pages there are by the first one's
    body, rows a body's rows of the schema. Bodies are kept in cache, so a page is asked for once.
    """

    def body(page: int) -> str | None:
        name = f"page-{page:08d}"
        if (known := read_kept(cache, name)) is None and (known := fetch(page)) is not None:
            keep(cache, name, known)
        return known

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            first = body(1)
            return [Page(k) for k in range(1, (total(first) if first is not None else 0) + 1)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            found = body(partition.value)
            return iter(()) if found is None else iter(rows(found))

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"pages_{uuid.uuid5(uuid.NAMESPACE_URL, cache).hex}"

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Pages)
    # a source without pages has no task, and so no plan of Spark's for it
    return spark.read.format(Pages.name()).load() if Reader().partitions() else spark.createDataFrame([], schema)


# ---------------------------------------------------------------- questions

def asked_once(items: DataFrame, answers: str, ask: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, key: str = "id") -> DataFrame:
    """Answers to items, of which only those without a kept answer are asked.

    ask takes frames of items and gives frames of the schema, which has the key; it may leave items out, which are
    asked again the next time. An answer is kept as soon as its frame is there. Items of null key have none; of an
    item that comes twice one task may ask twice, and the last answer stays.
    """
    names = [part.strip().split(" ")[0].strip("`:") for part in schema.split(",")]
    file_of = lambda value: hashlib.sha256(str(value).encode()).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known = {k: read_kept(answers, file_of(k)) for k in frame[key].unique()}
            told = [json.loads(v) for v in known.values() if v is not None]
            if told:
                yield pd.DataFrame(told, columns=names)
            todo = frame[frame[key].map(lambda k: known[k] is None)].drop_duplicates(key)  # noqa: B023
            for answer in ask(iter([todo])) if len(todo) else ():
                for row in json.loads(answer[names].to_json(orient="records", date_format="iso")):
                    keep(answers, file_of(row[key]), json.dumps(row))
                yield answer[names]

    # equal keys meet in one task, so an item is asked by one
    return items.filter(F.col(key).isNotNull()).repartition(key).mapInPandas(run, schema)


# ---------------------------------------------------------------- sheets

class Part(WriterCommitMessage):
    """What a task has written."""

    def __init__(self, name: str | None, rows: int):
        self.name, self.rows = name, rows


def _cell(value: object) -> object:
    if value is None:
        return ""
    if isinstance(value, str):
        return value[:CELL] + CUT if len(value) > CELL else value
    return value if isinstance(value, (bool, int, float)) else str(value)


class _Writer:
    """Tasks' parts, and their commit under one name."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Part:
        lines = [json.dumps({k: _cell(v) for k, v in row.asDict().items()}) for row in iterator]
        if not lines:
            return Part(None, 0)
        name = f"part-{uuid.uuid4().hex}.json"
        keep(f"{self.path}/parts", name, "\n".join(lines) + "\n")
        return Part(name, len(lines))

    def _drop(self, parts: list[Part | None]) -> None:
        system, path = store(f"{self.path}/parts")
        for part in parts:
            if part is not None and part.name and system.get_file_info(at := posixpath.join(path, part.name)).type == fs.FileType.File:
                system.delete_file(at)

    def _commit(self, parts: list[Part | None], name: str) -> None:
        known = read_kept(f"{self.path}/commits", name)
        if known is not None:  # the batch was committed before it came again
            self._drop([p for p in parts if p is not None and p.name not in json.loads(known)])
            return
        keep(f"{self.path}/commits", name, json.dumps([p.name for p in parts if p is not None and p.name]))


class BatchWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, f"once-{uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        self._drop(messages)


class StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, f"batch-{batchId:010d}")

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class Sheet(DataSource):
    """df.write.format("sheet") or writeStream: rows appended to the sheet in option path; null cells are empty, long ones cut."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a sheet is appended to")
        return BatchWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return StreamWriter(self.options["path"])


def append_sheet(rows: DataFrame, path: str) -> None:
    """Append a table's rows to a sheet, all or none."""
    rows.sparkSession.dataSource.register(Sheet)
    rows.write.format("sheet").option("path", path).mode("append").save()


def stream_sheet(rows: DataFrame, path: str, checkpoint: str):
    """A writer that appends a stream's batches to a sheet, each once however often it comes."""
    rows.sparkSession.dataSource.register(Sheet)
    return rows.writeStream.format("sheet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows of a sheet."""
    system, folder = store(f"{path}/commits")
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = sorted(n for f in found if f.type == fs.FileType.File for n in json.loads(read_kept(f"{path}/commits", f.base_name) or "[]"))
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/parts/{n}" for n in names])


def trials(spark: SparkSession, csv_paths: list[str], json_paths: list[str]) -> DataFrame:
    """Trials of several exports, one row of (pid, practice, sid): the first in the order of the files and of the rows in them wins.

    JSON exports hold an array results, of which only rows of type trial count; CSV exports are in files, each small enough for its rows to have numbers.
    """
    kinds = {"practice": "int", "n_words": "int", "rt_ms": "double"}
    frames = []
    for k, path in enumerate(csv_paths):
        own = spark.read.option("header", True).option("multiLine", True).csv(path)
        frames.append(own.select("*", F.lit(k).alias("_source"), F.monotonically_increasing_id().alias("_row")))  # one unsplit file
    for k, path in enumerate(json_paths, len(csv_paths)):
        own = spark.read.option("multiLine", True).json(path).select(F.posexplode("results").alias("_row", "r")).select("r.*", F.lit(k).alias("_source"), F.col("_row").cast("long"))
        frames.append(own.filter("type = 'trial'").drop("type"))
    if not frames:
        raise ValueError("no export is given")
    strings = [f.select(*(F.col(c).cast("string").alias(c) for c in f.columns if c not in ("_source", "_row")), "_source", "_row") for f in frames]
    every = strings[0]
    for frame in strings[1:]:
        every = every.unionByName(frame, allowMissingColumns=True)
    for name, kind in kinds.items():
        if name in every.columns:
            flag = F.when(F.lower(name) == "true", "1").when(F.lower(name) == "false", "0").otherwise(F.col(name)) if name == "practice" else F.col(name)
            every = every.withColumn(name, flag.try_cast(kind))
    from lumenread.sources.readers import first_of

    return first_of(every, ["pid", "practice", "sid"], ["_source", "_row"]).drop("_source", "_row")
