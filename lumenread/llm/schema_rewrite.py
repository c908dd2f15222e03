"""Rewriting files whose schemas have drifted: columns are found by their field ids, not by their names.

A table is put in a total order and dealt to files of equal size: a range-partitioned sort writes
its partitions as runs, the runs' row counts are summed up in order, and so a row's rank is its
run's first rank plus its place in the run. A file is then one task's: it gets the ranks of its
file in order and writes them, a batch at a time. The rewrite has one task for each file, too. It
reads the file's batches, takes each column of the target schema by its id, casts it or fills it,
writes the replacement beside the file and describes it. Afterwards the old files are removed.

A task writes under a name of its own in a staging folder and renames when the file is whole, so a
lost or repeated task leaves no half file; drifted files go only once every replacement is there
and described in a table, so a lost rewrite can be begun again. Files that match stay untouched.

What goes to one task or to all of them: the runs' counts, at most RUNS of them, whatever the input.

Defined results: null keys come first. Rows of equal keys are ordered by their other columns;
rows that are equal as a whole are spread over runs by the scan's random numbers, which tells them
apart no further. Empty tables make no files. Columns of the input beyond the schema aren't read;
their names don't matter. A file without an id has that column filled; null values stay null; a
value that doesn't fit its column raises. Texts of any length pass, a row group in memory at once.
"""

from __future__ import annotations

import hashlib
import math
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as filesystems
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Runs of the sort; it bounds what is counted and broadcast.
RUNS = 1024
#: Rows and bytes of a row group, whichever is reached first, and rows that are read at once.
GROUP_ROWS, GROUP_BYTES, READ_ROWS = 50_000, 64 << 20, 8192
ID = b"PARQUET:field_id"


@dataclass(frozen=True)
class Field:
    """A column of the target schema: its id, name, Arrow type and what files without it get."""

    id: int
    name: str
    kind: pa.DataType
    missing: object = None

    def arrow(self, name: str | None = None, kind: pa.DataType | None = None) -> pa.Field:
        return pa.field(name or self.name, kind or self.kind, nullable=True, metadata={ID: str(self.id)})


def store(uri: str) -> tuple[filesystems.FileSystem, str]:
    """The file system and the path of a URI of the shared folder."""
    if uri.startswith("file:") or "://" not in uri:
        return filesystems.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return filesystems.FileSystem.from_uri(uri)


def row_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to row groups."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GROUP_ROWS or size >= GROUP_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def write_whole(folder: str, name: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> str:
    """Write a file under a name that is only this attempt's, beside the folder, and move it there when it is whole; its URI."""
    system, path = store(folder)
    attempt = posixpath.join(f"{path}-staging", f"{uuid.uuid4().hex}.parquet")
    for needed in (f"{path}-staging", path):
        system.create_dir(needed, recursive=True)
    with system.open_output_stream(attempt) as out, pq.ParquetWriter(out, schema, compression="zstd") as writer:
        for group in row_groups(batches):
            writer.write_table(group, row_group_size=GROUP_ROWS)
    system.move(attempt, posixpath.join(path, name))
    return f"{folder}/{name}"


# ---------------------------------------------------------------- ranks and files

def ranked(rows: DataFrame, key: list[Column], name: str = "runs") -> DataFrame:
    """The rows with rank, their place in the order of key (nulls first) and then of all columns."""
    spark = rows.sparkSession
    columns = rows.columns
    order = [F.col(f"__key{i}").asc_nulls_first() for i in range(len(key))] + [F.col(f"`{c}`").asc_nulls_first() for c in columns]
    keyed = rows.select(*columns, *(k.alias(f"__key{i}") for i, k in enumerate(key)), F.rand(7).alias("__spread"))
    runs = min(RUNS, common.sized_partitions(spark, rows, 64 << 20))
    path = common.scratch_path(spark, name)
    keyed.repartitionByRange(runs, *order, F.col("__spread")).sortWithinPartitions(*order).select(*columns).write.option("compression", "zstd").parquet(path)
    # a task's rows can be several files; their names are in the order of the runs and of the rows in them
    parts = spark.read.schema(rows.schema).parquet(path).select(*columns, F.col("_metadata.file_name").alias("__run"), F.col("_metadata.row_index").alias("__at"))
    counts = parts.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(F.col("__run"), F.coalesce(before, F.lit(0)).alias("__first"))
    return parts.join(F.broadcast(first), "__run").select(*columns, (F.col("__first") + F.col("__at")).alias("rank"))


def write_files(rows: DataFrame, file_no: str, order: str, root: str, schema_of: Callable[[int], tuple[pa.Schema, Callable[[pa.RecordBatch], pa.RecordBatch]]], files: int) -> DataFrame:
    """Write the rows of each file_no (0 to files - 1) as one file, in order; file_no, n_rows, path of each.

    schema_of gives a file's schema and how its batches are made from the rows' columns.
    """
    columns = [c for c in rows.columns if c not in (file_no, order)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (b for b in batches if b.num_rows)
        first = next(rest, None)
        if first is None:
            return
        number, n = first.column(file_no)[0].as_py(), 0
        schema, made = schema_of(number)

        def all_batches() -> Iterator[pa.RecordBatch]:
            nonlocal n
            for batch in (b for part in ((first,), rest) for b in part):
                n += batch.num_rows
                yield made(batch.select(columns))

        path = write_whole(root, f"{number:06d}.parquet", schema, all_batches())
        yield pa.RecordBatch.from_pydict({"file_no": [number], "n_rows": [n], "path": [path]}, pa.schema([("file_no", pa.int64()), ("n_rows", pa.int64()), ("path", pa.string())]))

    owned = rows.repartitionById(max(1, files), F.col(file_no).cast("int")).sortWithinPartitions(order)
    return owned.mapInArrow(run, "file_no long, n_rows long, path string")


# ---------------------------------------------------------------- the rewrite

def ids_of(schema: pa.Schema) -> dict[int, int]:
    """Places of the columns of a file by field id; columns without one are passed over."""
    return {int(f.metadata[ID]): i for i, f in enumerate(schema) if f.metadata and ID in f.metadata}


def matches(schema: pa.Schema, fields: list[Field]) -> bool:
    """Whether a file has exactly the target's columns: ids, names, types and order."""
    return [(f.name, f.type, (f.metadata or {}).get(ID)) for f in schema] == [(f.name, f.kind, str(f.id).encode()) for f in fields]


def rebuilt(batch: pa.RecordBatch, fields: list[Field]) -> pa.RecordBatch:
    """A batch with the target's columns, found by id, cast or filled."""
    places = ids_of(batch.schema)
    columns = [
        pc.cast(batch.column(places[f.id]), f.kind) if f.id in places else pa.nulls(batch.num_rows, f.kind) if f.missing is None else pa.repeat(pa.scalar(f.missing, f.kind), batch.num_rows) for f in fields]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.arrow() for f in fields]))


class Described:
    """What is told of a file whose batches go by; more is kept in subclasses."""

    #: Arrow columns that results() gives.
    columns: list[tuple[str, pa.DataType]] = [("n_rows", pa.int64()), ("n_nulls", pa.int64())]

    def __init__(self) -> None:
        self.n_rows, self.n_nulls = 0, 0

    def see(self, batch: pa.RecordBatch) -> None:
        self.n_rows += batch.num_rows
        self.n_nulls += sum(c.null_count for c in batch.columns)

    def results(self) -> list:
        return [self.n_rows, self.n_nulls]


def rewrite(files: DataFrame, root: str, fields: list[Field], described: type[Described] = Described, at_most: int | None = None) -> DataFrame:
    """Give every file of files (file_no, path), which are in folder root, the schema of fields; what each is now.

    file_no is less than at_most (None: than the number of files). Rows and their order stay. Result, from a
    table that is written beside the folder: file_no, path, rewritten, start_columns, columns and what described tells.
    """
    spark = files.sparkSession
    kinds = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("rewritten", pa.bool_()), ("start_columns", pa.string()), ("columns", pa.string()), ("old", pa.string()), *described.columns])
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}

    def one(number: int, path: str) -> list:
        system, local = store(path)
        tells = described()
        with system.open_input_file(local) as source:
            file = pq.ParquetFile(source)
            schema = file.schema_arrow
            batches = (rebuilt(b, fields) for b in file.iter_batches(READ_ROWS))

            def seen() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    tells.see(batch)
                    yield batch

            target, old = path, None
            if matches(schema, fields):
                for _ in seen():
                    pass
            else:
                target, old = write_whole(root, posixpath.basename(path).replace(".parquet", "-evolved.parquet"), pa.schema([f.arrow() for f in fields]), seen()), path
        return [number, target, old is not None, ",".join(schema.names), ",".join(f.name for f in fields), old, *tells.results()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column("file_no").to_pylist(), batch.column("path").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one(number, path), kinds, strict=True)], schema=kinds)

    tasks = max(1, files.count() if at_most is None else at_most)
    done = files.select("file_no", "path").repartitionById(tasks, F.col("file_no").cast("int")).mapInArrow(run, ", ".join(f"`{f.name}` {names[f.type]}" for f in kinds))
    done = common.write(done, f"{root}-described")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("old").to_pylist():
                system, local = store(path)
                if system.get_file_info(local).type != filesystems.FileType.NotFound:
                    system.delete_file(local)
            yield batch

    done.filter("old is not null").select("old").mapInArrow(remove, "old string").write.format("noop").mode("overwrite").save()
    return done.drop("old")


# ---------------------------------------------------------------- clients that drift by a version

def client_fields(schema: pa.Schema) -> list[Field]:
    """The evolved schema of clients: its columns with ids from 1, nation_id long."""
    missing = {"nation_id": -1, "source": "none"}
    return [Field(i, f.name, pa.int64() if f.name == "nation_id" else f.type, missing.get(f.name)) for i, f in enumerate(schema, 1)]


def version_of(file_no: int) -> int:
    from zlib import crc32

    version = crc32(f"42:{file_no}".encode()) % 24
    return version if version <= 15 else 0


def drifted(fields: list[Field], version: int) -> tuple[pa.Schema, Callable[[pa.RecordBatch], pa.RecordBatch]]:
    """The schema of a starting file of a version, and its batches from batches of the columns of clients."""
    renamed = {"name": "email", "email": "name"} if version & 1 else {}
    kinds = {"balance": pa.float32(), "nation_id": pa.int32()} if version & 8 else {}
    gone = {"nation_id", "source"} if version & 4 else set()
    first, *rest = [f for f in fields if f.name not in gone]
    kept = [first, *(rest[::-1] if version & 2 else rest)]
    schema = pa.schema([f.arrow(renamed.get(f.name), kinds.get(f.name)) for f in kept])
    narrow = lambda column, kind: pc.cast(column, kind, safe=not pa.types.is_floating(kind))  # noqa: E731  a float loses digits
    return schema, lambda batch: pa.RecordBatch.from_arrays([narrow(batch.column(f.name), k.type) for f, k in zip(kept, schema, strict=True)], schema=schema)


class ClientDigests(Described):
    """Digests of a file's client ids and of its rows as text."""

    columns = [*Described.columns, ("ids_sha256", pa.string()), ("rows_sha256", pa.string())]

    def __init__(self) -> None:
        super().__init__()
        self.ids, self.rows = hashlib.sha256(), hashlib.sha256()

    @staticmethod
    def spelled(column: pa.Array, name: str) -> list[str]:
        if name == "balance":
            return ["?" if v is None else str(math.floor(1048576 * v)) if math.isfinite(v) else str(v) for v in column.to_pylist()]
        if pa.types.is_timestamp(column.type):
            column = pc.cast(pc.cast(column, pa.timestamp("us", column.type.tz)), pa.int64())
        return ["?" if v is None else str(v) for v in column.to_pylist()]

    def see(self, batch: pa.RecordBatch) -> None:
        start = self.n_rows == 0
        super().see(batch)
        columns = [self.spelled(c, f.name) for c, f in zip(batch.columns, batch.schema, strict=True)]
        if batch.num_rows:
            self.ids.update(f"{'' if start else ','}{','.join(columns[0])}".encode())
            self.rows.update(("" if start else "\n").encode() + "\n".join(map("|".join, zip(*columns, strict=True))).encode())

    def results(self) -> list:
        return [*super().results(), self.ids.hexdigest(), self.rows.hexdigest()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    clients = common.read(spark, sf_dir, "clients")
    names = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
    return rewrite_clients(clients.select(*names))


def rewrite_clients(clients: DataFrame) -> DataFrame:
    """The starting files of clients, in a new folder, rewritten to the evolved schema: one row a file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = clients.sparkSession
    root = f"{common.shared_dir(spark)}/lumenread-{common.fresh_name()}-clients"
    fields = client_fields(to_arrow_schema(clients.schema))
    rows = clients.count()
    each = 1 + rows // 500
    files = -(-rows // each)
    crc = F.crc32(F.coalesce(F.col("client_id").cast("string"), F.lit("")))
    placed = ranked(clients, [crc, F.col("client_id")]).withColumn("file_no", F.floor(F.col("rank") / each).cast("long"))
    started = common.write(write_files(placed, "file_no", "rank", root, lambda number: drifted(fields, version_of(number)), files), f"{root}-started")
    done = rewrite(started, root, fields, ClientDigests, files)
    version = F.crc32(F.concat(F.lit("42:"), F.col("file_no").cast("string"))) % 24
    return done.select(
        "file_no", F.when(version > 15, 0).otherwise(version).cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")
