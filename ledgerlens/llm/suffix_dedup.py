"""Removal of long byte strings that occur earlier in the corpus.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier:
in a document of smaller id, or earlier in the same one.  Everything is exact.

1. Every window of ``length`` bytes has an anchor, the ANCHOR-byte string inside
   it with the least hash (the rightmost of equals).  Equal windows have equal
   anchors at equal offsets, so they meet if anchors meet; consecutive windows
   with one anchor form a segment.  Each task packs the anchors of its block of
   documents into a few compressed blocks, dealt by anchor.
2. A segment equal to an earlier one goes whole.  Anchors with several distinct
   segments are candidates, each distinct segment once.
3. The candidates' bytes are read and dealt by anchor into shards.  Each shard
   is sorted by induced sorting (``suffix_array``), permuted common prefixes tell
   the windows that agree on ``length`` bytes, and all but the earliest go.
4. The runs of each document are merged and cut out of its bytes.

Copies inside one block are settled there and handed on once, so a frequent
passage costs a row per block.  The different segments of one frequent anchor
are at most HOT per block in step 2; if a block has more, that anchor's segments
skip the shard and are compared window by window, dealt by the window's own
128-bit hash, which splits the anchor over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import chunks, materialise, pack, shuffle_partitions, text_bytes, unpack_all
from ledgerlens.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
ANCHOR = 32
#: Distinct segments of one anchor that a block of documents deals to the
#: anchor's task; the others are compared window by window.
HOT = 64
#: Bytes of text per block of documents, per hashing step, and per shard.
BLOCK, STEP, SHARD = 16 << 20, 2 << 20, 1 << 19

_ROWS = ["<u8", "<u8", "<i8", "<i4", "<u4", "<u1", "<u1"]  # anchor, segment, id, tie, start, windows, flag
_ANCHORS, _WINDOWS, _DONE, _BYTES = range(4)


def _hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all ``width``-byte strings, by doubling (a power of 2)."""
    seed = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    seed = (seed ^ (seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h, w = (seed ^ (seed >> np.uint64(32)))[buf], 1
    while w < width:
        h = (h[:-w] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[w:] + (h[w:] >> np.uint64(29)))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        w *= 2
    return h ^ (h >> np.uint64(31))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values."""
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[:len(x) - (width - w)], x[width - w:]) if width > w else x


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, anchor, segment hash, first window, windows) of texts of at
    least ``length`` bytes, by the step; a longer text is cut into pieces that
    overlap by ``length - 1`` bytes, at places fixed by the text itself."""
    def emit(parts, owner, offset):
        raw = b"".join(parts)
        buf = np.frombuffer(raw, np.uint8)
        h = _hashes(buf, ANCHOR)
        mark = (1 << 24) - 1
        key = (h & ~np.uint64(mark)) | (np.uint64(mark) - np.arange(len(h), dtype=np.uint64))
        low = _least(key, length - ANCHOR + 1)
        sizes = np.array([len(p) for p in parts])
        begin = np.cumsum(sizes) - sizes
        inside = np.ones(len(low), bool)
        for e in (begin + sizes)[:-1]:
            inside[e - length + 1:e] = False
        change = np.concatenate(([True], (low[1:] != low[:-1]) | ~inside[:-1]))
        first = np.flatnonzero(inside & change)
        last = np.flatnonzero(inside & np.append(change[1:] | ~inside[1:], True))
        place = mark - (low[first] & np.uint64(mark)).astype(np.int64)
        part = np.searchsorted(begin, first, "right") - 1
        ends = last + length
        seg = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), ends.tolist())], np.uint64)
        return np.array(owner)[part], h[place], seg, first - begin[part] + np.array(offset)[part], last - first + 1

    parts, owner, offset, held = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), STEP):
            piece = t[at:at + STEP + length - 1]
            if len(piece) < length:
                continue
            if held and held + len(piece) > 4 * STEP:
                yield emit(parts, owner, offset)
                parts, owner, offset, held = [], [], [], 0
            parts.append(piece)
            owner.append(i)
            offset.append(at)
            held += len(piece)
            if held >= STEP:
                yield emit(parts, owner, offset)
                parts, owner, offset, held = [], [], [], 0
    if parts:
        yield emit(parts, owner, offset)


def _rows(keys: list, kinds: list, blocks: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blocks, pa.binary())],
        names=["key", "kind", "block"])


def _first_of_each(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by (anchor, segment, id, tie, start), and which come first
    for their (anchor, segment)."""
    order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    new = np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))) if len(order) else np.empty(0, bool)
    return cols, new


def _deal(cols: list[np.ndarray], kind: int, tasks: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Rows as one block for each task key, repeated ones settled here."""
    cols, new = _first_of_each(cols)
    done = [c[~new] for c in cols]
    if len(done[0]):
        yield _rows([salt % tasks], [_DONE], [pack(done)])
    cols = [c[new] for c in cols]
    if kind == _ANCHORS and len(cols[0]):
        starts = np.concatenate(([True], cols[0][1:] != cols[0][:-1]))
        rank = np.arange(len(starts)) - np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
        over = np.bincount(np.cumsum(starts))[np.cumsum(starts)] > HOT
        cols[6][over] = 1
        out = rank >= HOT
        if out.any():  # straight to the comparison by window
            yield _rows([salt % tasks], [_WINDOWS], [pack([c[out] for c in cols])])
        cols = [c[~out] for c in cols]
    key = (cols[0] % np.uint64(tasks)).astype(np.int32)
    order = np.argsort(key, kind="stable")
    cols, key = [c[order] for c in cols], key[order]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
    some = [(int(key[a]), pack([c[a:b] for c in cols])) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]
    yield _rows([k for k, _ in some], [kind] * len(some), [b for _, b in some])


_FOUND = "id long, tie int, start int, windows int, anchor long, kind int"


def _found(cols: list[np.ndarray], kinds: np.ndarray) -> pa.Table:
    return pa.table({"id": cols[2], "tie": cols[3], "start": cols[4].astype(np.int32),
                     "windows": cols[5].astype(np.int32), "anchor": cols[0].view(np.int64),
                     "kind": kinds.astype(np.int32)})


def _settle(table: pa.Table) -> pa.Table:
    """One task key's blocks: runs that go (_DONE), candidates for the shards
    (_BYTES) and for the comparison by window (_WINDOWS)."""
    kinds = table["kind"].to_numpy()
    blocks = table["block"].to_pylist()
    of = {k: [b for b, x in zip(blocks, kinds, strict=True) if x == k] for k in (_ANCHORS, _WINDOWS, _DONE)}
    done, over = unpack_all(of[_DONE], _ROWS), unpack_all(of[_WINDOWS], _ROWS)
    cols, new = _first_of_each(unpack_all(of[_ANCHORS], _ROWS))
    n = len(new)
    group = np.cumsum(np.concatenate(([True], cols[0][1:] != cols[0][:-1]))) - 1 if n else np.empty(0, np.int64)
    several = np.bincount(group, weights=new)[group] > 1 if n else np.empty(0, bool)
    hot = np.bincount(group, weights=cols[6])[group] > 0 if n else np.empty(0, bool)
    kind = np.where(new, np.where(hot, _WINDOWS, _BYTES), _DONE)
    keep = ~new | several | hot
    parts = [[c[keep] for c in cols], done, over]
    kinds = [kind[keep], np.full(len(done[0]), _DONE), np.full(len(over[0]), _WINDOWS)]
    return _found([np.concatenate(x) for x in zip(*parts, strict=True)], np.concatenate(kinds))


def _shard(segments: list[tuple], length: int) -> list[np.ndarray]:
    """The windows of a shard's segments (anchor, id, tie, start, bytes) that
    occur earlier in it, as rows of one window each."""
    sizes = np.array([len(s[4]) for s in segments])
    text = np.frombuffer(b"\xff".join(s[4] for s in segments), np.uint8)  # 0xFF is in no UTF-8 text
    begin = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_array(text)
    common = permuted_common_prefixes(text, order, length)
    joined = common[order] >= length
    group = np.cumsum(~joined)
    size = np.bincount(group)
    order, group = order[size[group] > 1], group[size[group] > 1]
    part = np.searchsorted(begin, order, "right") - 1
    whole = order - begin[part] + length <= sizes[part]  # not over a segment's end
    order, group, part = order[whole], group[whole], part[whole]
    ids, ties, at = (np.array([s[i] for s in segments], t)[part] for i, t in ((1, np.int64), (2, np.int32), (3, np.int64)))
    at = at + order - begin[part]
    by = np.lexsort((at, ties, ids, group))
    later = np.concatenate(([False], group[by][1:] == group[by][:-1])) if len(by) else np.empty(0, bool)
    by = by[later]
    zero = np.zeros(len(by), np.uint64)
    return [zero, zero, ids[by], ties[by], at[by].astype(np.uint32), np.ones(len(by), np.uint8), np.zeros(len(by), np.uint8)]


def _runs(cols: list[np.ndarray]) -> pa.Table:
    """One row per run of neighbouring windows of a document."""
    order = np.lexsort((cols[4], cols[3], cols[2]))
    cols = [c[order] for c in cols]
    ids, ties, at = cols[2], cols[3], cols[4].astype(np.int64)
    reach = at + cols[5]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]) | (at[1:] != reach[:-1]))) if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[:len(first)] - 1
    return pa.table({"id": ids[first], "tie": ties[first], "start": at[first].astype(np.int32),
                     "windows": (reach[last] - at[first]).astype(np.int32)})


def _keyed(docs: DataFrame, id_col: str, text: str, keep: list | None) -> DataFrame:
    return docs.select(
        F.struct(*(keep or ["*"])).alias("row"),
        F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.hash(F.coalesce(docs[text], F.lit(""))).alias("tie"),
        text_bytes(docs[text]).alias("body"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, tie, start, windows): the window starts of every document whose
    ``length`` bytes start earlier in the corpus; tie is a hash of the text."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text, [id_col]).select("id", "tie", "body")
    size = keyed.agg(F.sum(F.length("body"))).first()[0] or 0
    tasks = int(max(4 * shuffle_partitions(spark), size // (8 << 20)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches, lambda b: b.column(2).nbytes, BLOCK):
            b = pa.Table.from_batches(held)
            ids, ties = b["id"].to_numpy(), b["tie"].to_numpy()
            order = np.lexsort((ties, ids))
            same = np.concatenate(([False], (ids[order][1:] == ids[order][:-1]) & (ties[order][1:] == ties[order][:-1]))) if len(order) else []
            order = order[~np.asarray(same, bool)]  # a repeated row is one document
            texts = b["body"].take(pa.array(order)).to_pylist()
            got = list(_segments(texts, length))
            if not got:
                continue
            doc, anchor, seg, start, many = (np.concatenate(x) for x in zip(*got, strict=True))
            cols = [anchor, seg, ids[order][doc], ties[order][doc], start.astype(np.uint32),
                    many.astype(np.uint8), np.zeros(len(doc), np.uint8)]
            yield from _deal(cols, _ANCHORS, tasks, int(ids[order[0]] % (1 << 31)))

    dealt = keyed.mapInArrow(anchors, "key int, kind int, block binary")
    found = materialise(dealt.groupBy("key").applyInArrow(_settle, _FOUND))

    wanted = (found.where(F.col("kind") != _DONE).groupBy("id", "tie")
              .agg(F.collect_list(F.struct("start", "windows", "anchor", "kind")).alias("wanted")))
    many = found.where(F.col("kind") == _BYTES).count()
    shards = int(max(shuffle_partitions(spark), many * (length + 40) // SHARD, 1))
    # A shard holds all segments of its anchors; repeated rows are one document.
    read = keyed.join(wanted, ["id", "tie"]).select("id", "tie", "body", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches, lambda b: b.nbytes, BLOCK):
            b = pa.Table.from_batches(held)
            singles, parts = [], {}
            for i, tie, body, todo in zip(*(b[c].to_pylist() for c in ("id", "tie", "body", "wanted")), strict=True):
                for w in todo:
                    a, n = w["start"], w["windows"]
                    if w["kind"] == _BYTES:
                        key = w["anchor"] % shards
                        parts.setdefault(key, []).append((w["anchor"], i, tie, a, body[a:a + n + length - 1]))
                    else:
                        for s in range(a, a + n):
                            d = xxhash.xxh3_128_intdigest(body[s:s + length])
                            singles.append((d >> 64, d & ((1 << 64) - 1), i, tie, s))
            if singles:
                x = [np.array(c, t) for c, t in zip(zip(*singles, strict=True), _ROWS, strict=False)]
                one = np.ones(len(x[0]), np.uint8)
                yield from _deal([*x, one, one - 1], _WINDOWS, tasks, int(x[2][0] % (1 << 31)))
            keys = sorted(parts)
            yield _rows([-1 - k for k in keys], [_BYTES] * len(keys), [_pack_segments(parts[k]) for k in keys])

    def compare(table: pa.Table) -> pa.Table:
        kinds, blocks = table["kind"].to_numpy(), table["block"].to_pylist()
        if (kinds == _BYTES).any():
            segments = [s for b in blocks for s in _unpack_segments(b)]
            segments = sorted(set(segments))
            return _runs(_shard(segments, length))
        done = unpack_all([b for b, k in zip(blocks, kinds, strict=True) if k == _DONE], _ROWS)
        cols, new = _first_of_each(unpack_all([b for b, k in zip(blocks, kinds, strict=True) if k == _WINDOWS], _ROWS))
        return _runs([np.concatenate([d, c[~new]]) for d, c in zip(done, cols, strict=True)])

    later = read.mapInArrow(cut, "key int, kind int, block binary").groupBy("key").applyInArrow(
        compare, "id long, tie int, start int, windows int")
    return found.where(F.col("kind") == _DONE).select("id", "tie", "start", "windows").union(later)


def _pack_segments(segments: list[tuple]) -> bytes:
    heads = [np.array(c, t) for c, t in zip(zip(*(s[:4] for s in segments), strict=True),
                                            ("<i8", "<i8", "<i4", "<u4"), strict=True)]
    heads.append(np.array([len(s[4]) for s in segments], "<u4"))
    head = pack(heads)
    return len(head).to_bytes(4, "little") + head + b"".join(s[4] for s in segments)


def _unpack_segments(block: bytes) -> list[tuple]:
    n = int.from_bytes(block[:4], "little")
    anchor, ids, ties, start, size = unpack_all([block[4:4 + n]], ["<i8", "<i8", "<i4", "<u4", "<u4"])
    at = 4 + n + np.concatenate(([0], np.cumsum(size.astype(np.int64))))
    return [(a, i, t, s, block[x:y]) for a, i, t, s, x, y in
            zip(anchor.tolist(), ids.tolist(), ties.tolist(), start.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``), with
    ``n_bytes`` long, ``kept`` (the remaining bytes) and ``spans``, the removed
    runs as (start, end) byte offsets.

    A null text is empty; texts under ``length`` bytes stay whole.  A null id
    comes after all others.  Rows that share id and text are one document and
    get the same result; of rows that share only the id, a hash of the text
    tells which comes first.
    """
    runs = materialise(repeated_runs(docs, id_col, text, length)).groupBy("id", "tie").agg(
        F.collect_list(F.struct("start", "windows")).alias("runs"))
    keyed = _keyed(docs, id_col, text, keep)
    joined = keyed.join(runs, ["id", "tie"], "left").select("row", "body", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            for body, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                gone = []
                for r in sorted((r["start"], r["start"] + r["windows"] + length - 1) for r in runs or ()):
                    if gone and r[0] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], r[1])
                    else:
                        gone.append(list(r))
                at, left = 0, []
                for x, y in gone:
                    left.append(body[at:x])
                    at = y
                kept.append(b"".join([*left, body[at:]]))
                spans.append([{"start": x, "end": y} for x, y in gone])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64()),
                 pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["row", "n_bytes", "kept", "spans"])

    schema = f"row {joined.schema['row'].dataType.simpleString()}, n_bytes long, kept binary, spans array<struct<start:int,end:int>>"
    return joined.mapInArrow(cut, schema)
