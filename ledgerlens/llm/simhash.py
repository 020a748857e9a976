"""SimHash near-duplicate detection with pivot distance tables.

Every text gets a 64-bit fingerprint of its word shingles.  Fingerprints at
most two bits apart are linked, and linked ones form a component.

Distinct fingerprints meet in buckets that share all bits but two of eight
bytes: two differing bits always lie within two bytes, so each link is in a
bucket, and a bucket holds at most 2**16 distinct fingerprints whatever the
corpus.  Inside the buckets the table of Hamming distances to fixed reference
fingerprints does the search: members are swept in the order of the first
reference, pairs whose distances to any reference differ by more than the limit
are dropped (the triangle inequality), and the survivors are verified bit by
bit.  A bucket hands on a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlens.llm.common import materialise, text_bytes
from ledgerlens.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
PIVOTS = 16


def _references(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the 64-bit golden-ratio sequence, mixed."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of the ASCII-lower-cased words' shingles; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    raw = np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), ">u8").astype("<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        bits = np.unpackbits(raw[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE, keep: list | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) in a struct ``row``,
    and ``fp`` long beside it."""
    wanted = docs.select(F.struct(*(keep or ["*"])).alias("row"), text_bytes(docs[text]).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["row", "fp"])

    schema = T.StructType([wanted.schema["row"], T.StructField("fp", T.LongType())])
    return wanted.mapInArrow(run, schema)


def _forest(run_of: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its component's least) inside runs of equal bucket.

    ``run_of`` is sorted; runs are independent."""
    table = np.bitwise_count(fps[:, None] ^ _references()[None, :]).astype(np.int16)
    order = np.lexsort((fps, table[:, 0], run_of))
    run_of, fps, table = run_of[order], fps[order], table[order]
    left, right = [], []
    at = np.arange(len(fps) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(fps)]
        near = (run_of[at + step] == run_of[at]) & (table[at + step, 0] - table[at, 0] <= limit)
        at = at[near]
        a = at
        for p in range(1, table.shape[1]):
            if not len(a):
                break
            a = a[np.abs(table[a + step, p] - table[a, p]) <= limit]
        a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= limit]
        left.append(a)
        right.append(a + step)
        step += 1
    a, b = np.concatenate(left or [at]), np.concatenate(right or [at])
    label = np.arange(len(fps))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(distinct: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """(u, v) long: a spanning forest of the links of each bucket among the
    distinct fingerprints ``distinct(fp)``.

    ``limit`` of the 8 bytes of a fingerprint are left free, all ways."""
    frees = [sum(0xFF << (8 * j) for j in pick) for pick in combinations(range(8), limit)]
    masks = [~m if m < 1 << 63 else ~(m - (1 << 64)) for m in frees]
    spread = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("way", "bucket")
    met = (distinct.select("fp", spread).repartition("way", "bucket").sortWithinPartitions("way", "bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for b in batches:
            cols = [np.concatenate([h, b.column(n).to_numpy(zero_copy_only=False)])
                    for h, n in zip(held, ("way", "bucket", "fp"), strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            yield from found([c[:cut] for c in cols])
        yield from found(held)

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        way, bucket, fp = cols
        if len(fp) < 2:
            return
        new = np.concatenate(([True], (way[1:] != way[:-1]) | (bucket[1:] != bucket[:-1])))
        run_of = np.cumsum(new)
        keep = np.bincount(run_of)[run_of] > 1
        if keep.any():
            u, v = _forest(run_of[keep], fp[keep].view(np.uint64), limit)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return met.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    width: int = SHINGLE, limit: int = MAX_BITS, keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` (of the columns ``keep``), with ``fp`` (long) and
    ``component_id``, the least id of the row's component.

    Null and empty texts and texts without a word have fingerprint zero and are
    linked like any other.  A null id never is a component's id; a component
    with null ids alone has a null one.  Repeated rows stay, with equal results.
    """
    rows = materialise(fingerprints(docs, text, width, keep and [id_col, *(c for c in keep if c != id_col)]))
    firsts = materialise(rows.groupBy("fp").agg(F.min(F.col("row")[id_col]).alias("first_id")))
    near = materialise(components(materialise(links(firsts.select("fp"), limit)))
                       .join(firsts, F.col("node") == F.col("fp")).select("fp", "label", "first_id"))
    groups = near.groupBy("label").agg(F.min("first_id").alias("component_id"))
    linked = near.join(materialise(groups), "label").select("fp", "component_id")
    alone = firsts.join(near.select("fp"), "fp", "left_anti").select("fp", F.col("first_id").alias("component_id"))
    return rows.join(materialise(linked.union(alone)), "fp").select("row", "fp", "component_id")
