"""Helpers shared by the operators: scratch tables, text columns, packing."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one of our own only
    for a local master without that setting."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        own = tempfile.TemporaryDirectory(prefix="ledgerlens-")
        atexit.register(own.cleanup)
        _OWN_DIR.append("file://" + own.name)
    return _OWN_DIR[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared scratch folder and read it back:
    lineage is cut, and a lost executor costs only what it was computing.
    The table lives as long as the application's checkpoint folder."""
    path = f"{scratch_dir(df.sparkSession)}/ledgerlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str | Column) -> Column:
    """The whole text as UTF-8 bytes; null is empty."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col, F.lit("")).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterable, sizes, limit: int) -> Iterator[list]:
    """Group consecutive Arrow batches until ``sizes(batch)`` sums to ``limit``."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += sizes(batch)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def pack(arrays: list[np.ndarray]) -> bytes:
    """Equal-length numpy columns as one compressed block (byte planes, so that
    high zero bytes vanish)."""
    n = len(arrays[0])
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(block: bytes, dtypes: list) -> list[np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    widths = [np.dtype(d).itemsize for d in dtypes]
    n = len(body) // sum(widths)
    out, at = [], 0
    for d, w in zip(dtypes, widths, strict=True):
        out.append(np.ascontiguousarray(body[at:at + n * w].reshape(w, n).T).view(d).reshape(n))
        at += n * w
    return out


def unpack_all(blocks: Iterable[bytes], dtypes: list) -> list[np.ndarray]:
    parts = [unpack(b, dtypes) for b in blocks]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, d) for i, d in enumerate(dtypes)]


def tree_sum(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], list | None], fan: int = 32) -> list | None:
    """Sums over all rows of a table that is read in many tasks.

    ``partial`` turns one task's batches into a list of arrays, of the same shapes
    in every task (None: no rows).  FAN tasks' arrays are added up in one task, FAN
    of those in the next, and so on, in the order of the partitions; the driver gets
    at most FAN of them.  None if no task had rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = partial(batches)
        if got is not None:
            yield _summand(TaskContext.get().partitionId(), got)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        return pa.Table.from_batches([_summand(table["at"][0].as_py() // fan, _added(table["body"].to_pylist()))])

    parts, many = rows.mapInArrow(run, "at long, body binary"), rows.rdd.getNumPartitions()
    while many > fan:
        parts, many = parts.groupBy(F.expr(f"at div {fan}")).applyInArrow(merge, "at long, body binary"), -(-many // fan)
    left = sorted((r["at"], bytes(r["body"])) for r in parts.collect())
    return _added([body for _, body in left]) if left else None


def _summand(at: int, arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([pickle.dumps(arrays)], pa.binary())], names=["at", "body"])


def _added(bodies: list[bytes]) -> list:
    total = None
    for body in bodies:
        arrays = pickle.loads(body)
        total = arrays if total is None else [a + b for a, b in zip(total, arrays, strict=True)]
    return total
