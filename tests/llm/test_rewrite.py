"""The schema rewrite against a plain reading of the contract."""

import hashlib
import math
import os
import struct
import zlib
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lumenread.llm import schema_rewrite

NAMES = "client_id master_id source updated_at name email city nation_id segment balance".split()
SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Rows of the contract by file, sorted and written by hand."""
    key = lambda r: (zlib.crc32(b"" if r[0] is None else str(r[0]).encode()), *((v is not None, v if v is not None else 0) for v in r))
    rows, each, out = sorted(rows, key=key), 1 + len(rows) // 500, []
    for first in range(0, len(rows), each):
        number = first // each
        version = zlib.crc32(f"42:{number}".encode()) % 24
        version = 0 if version > 15 else version
        columns = [NAMES[0], *(NAMES[:0:-1] if version & 2 else NAMES[1:])]
        columns = [c for c in columns if not (version & 4 and c in ("nation_id", "source"))]
        start = [{"name": "email", "email": "name"}.get(c, c) if version & 1 else c for c in columns]
        text, nulls = [], 0
        for r in rows[first : first + each]:
            v = dict(zip(NAMES, r, strict=True))
            if version & 4:
                v |= {"nation_id": -1, "source": "none"}
            if version & 8 and v["balance"] is not None:
                v["balance"] = struct.unpack("f", struct.pack("f", v["balance"]))[0]
            nulls += sum(x is None for x in v.values())
            if v["balance"] is not None:
                v["balance"] = math.floor(1048576 * v["balance"])
            if v["updated_at"] is not None:
                v["updated_at"] = (v["updated_at"] - datetime(1970, 1, 1)) // timedelta(microseconds=1)
            text.append(["?" if x is None else str(x) for x in v.values()])
        out.append((number, version, len(text), nulls, sha(",".join(t[0] for t in text)), sha("\n".join(map("|".join, text))), ",".join(start), ",".join(NAMES), version != 0))
    return out


def made(n, repeat=0):
    when = datetime(2024, 1, 1)
    rows = [
        (i if i != 5 else None, i // 2 if i % 7 else None, None if i % 9 == 0 else "crm", None if i % 11 == 0 else when + timedelta(seconds=i, microseconds=i), f"Name|{i}" if i % 6 else "", None if i % 5 == 0 else f"é{i}@x\n",
         "c" * (50_000 if i == 3 else i % 4), None if i % 8 == 0 else i % 25, "retail", None if i % 13 == 0 else i * 1.37 - 300) for i in range(n)]
    return rows + ([rows[3], rows[4], (rows[6][0], *rows[5][1:])] * repeat if repeat else [])


def check(found, rows):
    want = plain(rows)
    columns = ["file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "rewritten"]
    assert sorted(tuple(r[c] for c in columns) for r in found) == want
    paths = [schema_rewrite.store(r["path"])[1] for r in found]
    if paths:
        assert sorted(os.path.join(os.path.dirname(paths[0]), f) for f in os.listdir(os.path.dirname(paths[0])) if not f.startswith(".")) == sorted(paths)
    for r, path in zip(found, paths, strict=True):
        schema = pq.read_schema(path)
        assert schema.names == NAMES and schema_rewrite.ids_of(schema) == {i + 1: i for i in range(10)}
        assert schema.field("nation_id").type == pa.int64() and schema.field("balance").type == pa.float64() and all(f.nullable for f in schema)
        assert path.endswith("-evolved.parquet") == r["rewritten"]


@pytest.mark.parametrize("rows", [[], made(1), made(40), made(700, repeat=5)], ids=["empty", "one", "few", "repeated"])
def test_contract(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: schema_rewrite.F.lit(1) for n in ("rank", "file_no", "run", "path")})
    check(schema_rewrite.rewrite_clients(frame.select(*NAMES)).collect(), rows)


def test_many_rows_of_one_key_are_spread(spark):
    rows = made(30) + [made(30)[7]] * 3000
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    placed = schema_rewrite.ranked(frame, [schema_rewrite.F.col("client_id")])
    assert sorted(r["rank"] for r in placed.collect()) == list(range(len(rows)))
    check(schema_rewrite.rewrite_clients(frame).collect(), rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/clients.parquet").select(*NAMES).collect()]
    first, second = (schema_rewrite.query(spark, "/root/testdata/sf0.001").collect() for _ in range(2))
    check(first, rows)
    assert {os.path.dirname(r["path"]) for r in first}.isdisjoint(os.path.dirname(r["path"]) for r in second)  # a new folder at every call


def test_a_lost_rewrite_can_be_begun_again(spark, tmp_path, monkeypatch):
    rows = made(60)
    frame = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    fields, root = schema_rewrite.client_fields(to_arrow_schema(frame.schema)), f"file://{tmp_path}/t"
    placed = schema_rewrite.ranked(frame, [schema_rewrite.F.crc32(schema_rewrite.F.coalesce(schema_rewrite.F.col("client_id").cast("string"), schema_rewrite.F.lit(""))), schema_rewrite.F.col("client_id")])
    placed = placed.withColumn("file_no", schema_rewrite.F.col("rank"))
    started = schema_rewrite.common.write(schema_rewrite.write_files(placed, "file_no", "rank", root, lambda n: schema_rewrite.drifted(fields, schema_rewrite.version_of(n)), 60), f"{root}-started")

    class Lost(schema_rewrite.ClientDigests):
        def results(self):
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        schema_rewrite.rewrite(started, root, fields, Lost).collect()
    assert len([f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".parquet") and "evolved" not in f]) == 60  # nothing old went
    check([r.asDict() | {"version": schema_rewrite.version_of(r["file_no"])} for r in schema_rewrite.rewrite(started, root, fields, schema_rewrite.ClientDigests).collect()], rows)


def test_columns_are_found_by_id_alone():
    fields = [schema_rewrite.Field(1, "a", pa.int64()), schema_rewrite.Field(2, "b", pa.string(), "none"), schema_rewrite.Field(3, "c", pa.float64())]
    old = pa.schema([pa.field("a", pa.float32(), metadata={schema_rewrite.ID: "3"}), pa.field("c", pa.int32(), metadata={schema_rewrite.ID: "1"}), pa.field("b", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([0.5, None], pa.float32()), pa.array([None, 4], pa.int32()), pa.array(["x", "y"])], schema=old)
    assert schema_rewrite.rebuilt(batch, fields).to_pydict() == {"a": [None, 4], "b": ["none", "none"], "c": [0.5, None]}
    assert schema_rewrite.rebuilt(batch.slice(0, 0), fields).num_rows == 0
