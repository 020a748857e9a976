"""Token counts of texts without their ids.

A byte-level BPE first cuts a text into pre-tokens, and the number of pieces of
a pre-token never depends on its surroundings.  So every block of documents is
cut once into its distinct pre-tokens and a sparse table of each document's
pre-token frequencies.  The distinct pre-tokens are dealt out by hash, equal
ones of all blocks meet, their pieces are counted once, and the counts go back
to the blocks, where frequency times count is summed.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import chunks, materialise, pack, shuffle_partitions, text_bytes, unpack

#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the pattern's classes are the same in every Unicode
#: version; texts with others are cut by the tokenizer's own pre-tokenizer.
STABLE = 0x0250
#: Bytes of text per block.
BLOCK = 16 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Cutter:
    """Cuts texts into pre-tokens as the tokenizer of a file does."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.odd = regex.compile(f"[^\\x00-{chr(STABLE - 1)}]").search

    def __call__(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return self._cut(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self._cut(p)], len(parts) - 1

    def _cut(self, text: str) -> list[str]:
        if not self.odd(text):
            return self.find(text)
        spans = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]


def _pieces(path: str, tokens: list[str]) -> np.ndarray:
    """Number of pieces of each pre-token.  They are cut no further: a
    pre-token that the tokenizer would cut again by itself can't occur."""
    tokenizer = _tokenizer(path)
    out = np.empty(len(tokens), "<u4")
    for at in range(0, len(tokens), 20_000):
        for i, e in enumerate(tokenizer.encode_batch(tokens[at:at + 20_000], add_special_tokens=False)):
            out[at + i] = len(e)
    return out


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``), with
    ``n_bytes`` and ``n_tokens`` (long) under the byte-level BPE of the file ``tokenizer``.

    Special strings in a text count as the tokenizer's own default has it: one
    token each.  A null text is empty and has no token.  Repeated rows stay.
    """
    spark = docs.sparkSession
    tasks = int(4 * shuffle_partitions(spark))
    wanted = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(docs[text], F.lit("")).alias("body"))
    row = wanted.schema["row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, task = Cutter(tokenizer), TaskContext.get().partitionId()
        for k, held in enumerate(chunks(batches, lambda b: b.column(1).nbytes, BLOCK)):
            b = pa.Table.from_batches(held).combine_chunks()
            number: dict = defaultdict()
            number.default_factory = number.__len__
            ids, many, extra = [], [], []
            for body in b["body"].to_pylist():
                found, special = cutter(body)
                got, freq = np.unique(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), return_counts=True)
                ids.append(np.diff(got, prepend=0))
                many.append(freq)
                extra.append(special)
            block = (task << 32) + k
            rows = b["row"].chunk(0)
            one = lambda values, kind: pa.array([values], kind)
            nested = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([
                one(block, pa.int64()), one(-1 - block % tasks, pa.int32()), nested,
                one(pa.compute.binary_length(b["body"]).to_pylist(), pa.list_(pa.int32())),
                one([len(x) for x in ids], pa.list_(pa.int32())), one(extra, pa.list_(pa.int32())),
                one(pack([np.concatenate(ids).astype("<u4"), np.concatenate(many).astype("<u4")]), pa.binary()),
                one(None, pa.binary())], names=names)
            home: dict = {}
            for token, i in number.items():
                raw = token.encode()
                home.setdefault(xxhash.xxh64_intdigest(raw) % tasks, []).append((raw, i))
            data, places = [], []
            for members in home.values():
                members.sort()
                data.append(zstandard.ZstdCompressor(level=1).compress(
                    np.array([len(r) for r, _ in members], "<u4").tobytes() + b"".join(r for r, _ in members)))
                places.append(pack([np.array([i for _, i in members], "<u4")]))
            n = len(home)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * n, pa.int64()), pa.array(list(home), pa.int32()), pa.nulls(n, nested.type),
                pa.nulls(n, pa.list_(pa.int32())), pa.array([[len(m)] for m in home.values()], pa.list_(pa.int32())),
                pa.nulls(n, pa.list_(pa.int32())), pa.array(data, pa.binary()), pa.array(places, pa.binary())], names=names)

    names = ["block", "task", "rows", "n_bytes", "sizes", "extra", "data", "ids"]
    schema = (f"block long, task int, rows array<{row}>, n_bytes array<int>, sizes array<int>, extra array<int>, "
              "data binary, ids binary")
    cut_table = materialise(wanted.mapInArrow(cut, schema))

    def count(table: pa.Table) -> pa.Table:
        lists = []
        for data, (n,) in zip(table["data"].to_pylist(), table["sizes"].to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(data)
            ends = 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64))
            starts = np.concatenate(([4 * n], ends[:-1]))
            lists.append([sys.intern(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        distinct = sorted({t for x in lists for t in x})
        pieces = dict(zip(distinct, _pieces(tokenizer, distinct).tolist(), strict=True))
        counts = [pack([np.array([pieces[t] for t in x], "<u4")]) for x in lists]
        return pa.table({"block": table["block"], "ids": table["ids"], "counts": pa.array(counts, pa.binary())})

    counted = (cut_table.where("task >= 0").select("block", "task", "sizes", "data", "ids")
               .groupBy("task").applyInArrow(count, "block long, ids binary, counts binary")
               .groupBy("block").agg(F.collect_list(F.struct("ids", "counts")).alias("parts")))
    base = cut_table.where("task < 0").select("block", "rows", "n_bytes", "sizes", "extra", "data")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in ("sizes", "extra", "data", "parts")}
                sizes = np.array(r["sizes"], np.int64)
                steps, freq = unpack(r["data"], ["<u4", "<u4"])
                pieces = np.zeros(1, np.int64)
                pairs = [(unpack(p["ids"], ["<u4"])[0], unpack(p["counts"], ["<u4"])[0]) for p in r["parts"] or ()]
                if pairs:
                    ids = np.concatenate([x for x, _ in pairs])
                    pieces = np.zeros(int(ids.max()) + 1, np.int64)
                    pieces[ids] = np.concatenate([x for _, x in pairs])
                # Ids are steps from the document's one before.
                run = np.concatenate(([0], np.cumsum(steps.astype(np.int64))))
                cut = np.concatenate(([0], np.cumsum(sizes)))
                ids = run[1:] - np.repeat(run[cut[:-1]], sizes)
                weight = np.concatenate(([0], np.cumsum(freq * pieces[ids] if len(ids) else np.zeros(0, np.int64))))
                tokens = weight[cut[1:]] - weight[cut[:-1]] + np.array(r["extra"], np.int64)
                rows = b.column("rows")[i].values
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(b.column("n_bytes")[i].as_py(), pa.int64()), pa.array(tokens, pa.int64())],
                    names=["row", "n_bytes", "n_tokens"])

    return (base.join(counted, "block", "left").mapInArrow(total, f"row {row}, n_bytes long, n_tokens long"))
