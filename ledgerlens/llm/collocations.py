"""Phrase collocations with an FM-index over word ids per shard.

1. Each task cuts its texts into pieces and words and numbers the words of a shard
   (SHARD bytes of text).  Words are counted over all shards; those under the least
   count can't be part of a candidate and end a piece, like punctuation.
2. Each shard keeps the Burrows-Wheeler transform of its remaining word ids.  The
   suffixes are sorted to DEPTH words, which is all that phrases of that length
   need: an interval of them is the set of a phrase's occurrences.
3. Depth by depth, all intervals are extended to the left through the transform;
   an extension lives only if both the phrase without its last word (its right parent) and
   the one without its first (its left parent) are frequent in the whole corpus.  The counts
   of the living phrases, with the words that the extensions added, are dealt by hash and
   summed across shards, and each shard gets a bit for each of its phrases back.
4. The frequent phrases meet their parts' counts in joins, which give scores,
   cuts and the phrases that a longer one covers; a rank a language ends it.

No count is dropped: a phrase under the least count in the whole corpus holds no
candidate, as every occurrence of a longer phrase is one of its parts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import materialise, pack, shuffle_partitions, text_bytes, unpack

DEPTH, LEAST, BEST = 4, 30, 2000
#: Bytes of text per shard, entries of a block row.
SHARD = 8 << 20
#: Share of its own count that a longer phrase covers a candidate with, as a fraction.
COVERED = (4, 5)
FACTOR = 2_000_000
NO_LANGUAGE = "und"

_STOP = b"\xff"  # in no UTF-8 text
_PIECES = bytes(0xFF if c in b".,;:!?\x0a\x0b\x0c\x0d" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHARDS = "shard long, local int, lang string, word string, n long, body binary"


# ---------------------------------------------------------------- 1: shards and words
def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row for each word of a shard (body null), and one with the shard's word ids in text order
    (0: between pieces).  A shard ends with the text that fills it."""
    running, held, shard = 0, 0, _Shard()
    for b in batches:
        for lang, body in zip(b.column(0), b.column(1), strict=True):
            shard.add(lang.as_py(), body.as_py())
            held += len(body.as_buffer())
            if held >= shard_bytes:
                yield from shard.rows((TaskContext.get().partitionId() << 24) + running)
                running, held, shard = running + 1, 0, _Shard()
    if held:
        yield from shard.rows((TaskContext.get().partitionId() << 24) + running)


class _Shard:
    def __init__(self):
        self.ids: dict[str, defaultdict[bytes, int]] = {}
        self.parts, self.number = [np.zeros(1, np.int32)], count(1)

    def add(self, lang: str, body: bytes) -> None:
        if lang not in self.ids:
            self.ids[lang] = defaultdict(self.number.__next__, {_STOP: 0})  # a new word gets the next number
        words = body.translate(_PIECES).replace(_STOP, b" \xff ").split()
        self.parts.append(np.fromiter(map(self.ids[lang].__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        text = np.concatenate(self.parts)
        counts = np.bincount(text, minlength=next(self.number))
        for lang, own in self.ids.items():
            del own[_STOP]
            local = np.fromiter(own.values(), np.int32, len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), shard)), pa.array(local), pa.array([lang] * len(own), pa.string()),
                 pa.array([w.decode() for w in own], pa.string()), pa.array(counts[local]), pa.nulls(len(own), pa.binary())],
                names=["shard", "local", "lang", "word", "n", "body"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
             pa.array([len(text)]), pa.array([pack([text])], pa.binary())], names=["shard", "local", "lang", "word", "n", "body"])


# ---------------------------------------------------------------- 2: the index
def bwt(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Burrows-Wheeler transform of ``text`` (whole numbers from 0, a 0 first and last) with the
    suffixes sorted to ``depth`` words, by doubling."""
    rank, width = text.astype(np.int64), 1
    order = np.arange(len(text))
    while width < depth:
        many = int(rank.max(initial=0)) + 1
        key = np.roll(rank, -width)
        key += rank * many
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        width *= 2
    return text[order - 1].astype(np.int32)



def _unbits(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


class Index:
    """An FM-index of a shard: the transform, and for each place of the suffix
    order where the suffix without its first word stands (the transform read
    backwards).  ``words`` holds the corpus-wide ids of the shard's words 1, 2, ..."""

    def __init__(self, transform: np.ndarray, words: np.ndarray):
        self.words = words
        self.after = np.argsort(transform, kind="stable").astype(np.int32)
        self.first = transform[self.after]
        self.inside = self.first - 1  # number of the interval a place is in; -1: in none that lives

    def extend(self) -> tuple[np.ndarray, np.ndarray]:
        """From all living intervals of a depth to those of the next: places where
        the new intervals start, and their sizes (the phrases' counts in the shard).
        A place lives on if the phrase without its last word (the interval it is in)
        and that without its first (the one its follower is in) both live."""
        right, left = self.inside, self.inside[self.after]
        lives = (right >= 0) & (left >= 0)
        new = lives.copy()
        new[1:] &= ~lives[:-1] | (right[1:] != right[:-1]) | (left[1:] != left[:-1])
        self.inside = np.where(lives, np.cumsum(new) - 1, -1).astype(np.int32)
        starts = np.flatnonzero(new)
        return starts, np.bincount(self.inside[lives], minlength=len(starts))

    def keep(self, living: np.ndarray) -> None:
        """Only the intervals marked live on."""
        self.inside = np.where((self.inside >= 0) & np.append(living, False)[self.inside], self.inside, -1)

    def phrases(self, starts: np.ndarray, depth: int) -> list[np.ndarray]:
        """The corpus-wide word ids of the phrases of intervals, a column a word."""
        out = []
        for _ in range(depth):
            out.append(self.words[self.first[starts] - 1])
            starts = self.after[starts]
        return out


def _buckets(ids: list[np.ndarray], tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases dealt by hash: order by task, the tasks met and where each begins in it."""
    h = np.zeros(len(ids[0]), np.uint64)
    for g in ids:
        h = (h ^ g.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    task = (h % np.uint64(tasks)).astype(np.int64)
    order = np.argsort(task, kind="stable")
    met, begin = np.unique(task[order], return_index=True)
    return order, met, np.append(begin, len(order))


# ---------------------------------------------------------------- 3: depth by depth
def _kinds(depth: int) -> list[str]:
    return ["<i8"] * depth + ["<u4"]


def _extended(indexes: DataFrame, replies: list[DataFrame], depth: int, tasks: int) -> DataFrame:
    """(task, shard, block): each shard's living phrases of ``depth`` words with their counts."""
    joined = indexes
    for d, reply in enumerate(replies, 2):
        bits = reply.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("task", "bits"))).alias(f"bits{d}"))
        joined = joined.join(bits, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                index = Index(unpack(b.column("transform")[i].as_py(), ["<i4"])[0], unpack(b.column("words")[i].as_py(), ["<i8"])[0])
                for d in range(2, depth + 1):
                    starts, counts = index.extend()
                    if not len(starts):
                        break
                    ids = index.phrases(starts, d)
                    order, met, begin = _buckets(ids, tasks)
                    if d == depth:
                        blocks = [pack([c[order[x:y]] for c in (*ids, counts.astype(np.uint32))]) for x, y in zip(begin, begin[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(met.astype(np.int32)), pa.array(np.full(len(met), b.column("shard")[i].as_py())),
                             pa.array(blocks, pa.binary())], names=["task", "shard", "block"])
                        break
                    living = np.zeros(len(starts), bool)
                    told = {r["task"]: r["bits"] for r in b.column(f"bits{d}")[i].as_py()}
                    for t, x, y in zip(met.tolist(), begin, begin[1:]):
                        living[order[x:y]] = _unbits(told[t], y - x)
                    index.keep(living)

    return joined.mapInArrow(run, "task int, shard long, block binary")


def _summed(blocks: DataFrame, depth: int, least: int) -> DataFrame:
    """Counts summed across shards: rows of frequent phrases (ids, n), and for each block the bits that
    tell which of its phrases are frequent (shard, task, bits)."""
    def run(table: pa.Table) -> pa.Table:
        task, shards = table["task"][0].as_py(), table["shard"].to_pylist()
        parts = [unpack(b, _kinds(depth)) for b in table["block"].to_pylist()]
        sizes = [len(p[0]) for p in parts]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort(cols[:depth][::-1])
        ids = [c[order] for c in cols[:depth]]
        new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in ids], axis=0)))
        group = np.cumsum(new) - 1
        total = np.bincount(group, cols[depth][order]).astype(np.int64)
        frequent = total >= least
        mine = np.empty(len(order), bool)
        mine[order] = frequent[group]
        first = np.flatnonzero(new)[frequent]
        flat = np.column_stack([c[first] for c in ids]) if len(first) else np.empty((0, depth), np.int64)
        ends = np.cumsum(sizes)
        bits = [np.packbits(mine[e - n:e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
        found, told = len(first), len(shards)
        return pa.table({
            "ids": pa.concat_arrays([pa.ListArray.from_arrays(pa.array(np.arange(found + 1, dtype=np.int32) * depth), pa.array(flat.ravel())),
                                     pa.nulls(told, pa.list_(pa.int64()))]),
            "n": pa.concat_arrays([pa.array(total[frequent]), pa.nulls(told, pa.int64())]),
            "shard": pa.concat_arrays([pa.nulls(found, pa.int64()), pa.array(shards, pa.int64())]),
            "task": pa.concat_arrays([pa.nulls(found, pa.int32()), pa.array([task] * told, pa.int32())]),
            "bits": pa.concat_arrays([pa.nulls(found, pa.binary()), pa.array(bits, pa.binary())])})

    return materialise(blocks.groupBy("task").applyInArrow(run, "ids array<long>, n long, shard long, task int, bits binary"))


def _index(joined: DataFrame) -> DataFrame:
    """(shard, transform, words) of shards with their text and the ids of their frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, body, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = unpack(body, ["<i4"])[0]
                local, ids = (known.values.field(f).to_numpy(zero_copy_only=False) for f in ("local", "id"))
                number = np.zeros(int(max(text.max(initial=0), local.max(initial=0))) + 1, np.int32)
                number[local] = np.arange(1, len(local) + 1)
                text = number[text]  # rare words end a piece like punctuation
                text = text[np.concatenate(([True], (text[1:] != 0) | (text[:-1] != 0)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([pack([bwt(text)])], pa.binary()), pa.array([pack([ids.astype(np.int64)])], pa.binary())],
                    names=["shard", "transform", "words"])

    return materialise(joined.select("shard", "body", "known").mapInArrow(run, "shard long, transform binary, words binary"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                     shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: all frequent phrases of 1 to DEPTH words (ids, n); the frequent words
    (id, lang, word, n); and the number of word occurrences of each lang (lang, total)."""
    spark = docs.sparkSession
    wanted = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text_bytes(docs[text]).alias("body"))
    shards = materialise(wanted.mapInArrow(lambda batches: _shards(batches, shard_bytes), _SHARDS))
    heard = shards.where("body is null")
    totals = heard.groupBy("lang").agg(F.sum("n").alias("total"))
    words = materialise(heard.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
                        .select(F.monotonically_increasing_id().alias("id"), "lang", "word", "n"))
    known = (heard.select("shard", "local", "lang", "word").join(words.select("id", "lang", "word"), ["lang", "word"])
             .groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("known")))
    indexes = _index(shards.where("body is not null").select("shard", "body").join(known, "shard"))

    many = shards.where("body is not null").count()
    tasks = max(many, shuffle_partitions(spark))
    phrases, replies = words.select(F.array("id").alias("ids"), "n"), []
    for depth in range(2, DEPTH + 1):
        found = _summed(_extended(indexes, replies, depth, tasks), depth, least)
        phrases = phrases.union(found.where("shard is null").select("ids", "n"))
        replies.append(found.where("shard is not null").select("shard", "task", "bits"))
    return phrases, words, totals


# ---------------------------------------------------------------- 4: scores and ranks
def _parts(size: Column, least: int) -> Column:
    """(at, many) of the contiguous parts of ``least`` words or more that are shorter than the phrase."""
    each = lambda many: F.transform(F.sequence(F.lit(1), size - many + 1), lambda at: F.struct(at.alias("at"), many.alias("many")))
    return F.flatten(F.transform(F.sequence(F.lit(least), size - 1), each))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, best: int = BEST,
                 shard_bytes: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, these at
    spaces and tabs into words.  A candidate has 2 to DEPTH words and occurs ``a`` >= ``least`` times;
    cutting it after k words gives the counts ``l`` and ``r`` of its parts, and its score is the least
    floor(FACTOR a / (l + r)), at the first k of equals.  Candidates inside a longer one with COVERED of their
    count go.  ``n`` counts all words of the language.  Order: score and count falling,
    phrase rising by its UTF-8 bytes.

    A null text is empty, a null language is ``und``; repeated rows count as often as they
    are there; very long texts are one shard; an empty table gives no rows.  Columns of other names are
    not looked at."""
    phrases, words, totals = frequent_phrases(docs, text, lang, least, shard_bytes)
    size = F.size("ids")
    candidates = phrases.where(size > 1)
    cuts = candidates.select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"),
                       F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = (cuts.join(phrases.select(F.col("ids").alias("head"), F.col("n").alias("l")), "head")
            .join(phrases.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("__s", exact("a") * F.lit(FACTOR).cast("decimal(10,0)")).withColumn("__t", exact("l") + exact("r"))
    scored = (cuts.groupBy("ids", "a").agg(F.min(F.struct(F.expr("__s div __t").alias("score"), "k", "l", "r")).alias("c"))
              .select("ids", "a", "c.l", "c.r", "c.score"))

    longer = (candidates.where(size > 2).select("ids", "n", F.explode(_parts(size, 2)).alias("p"))
              .groupBy(F.slice("ids", F.col("p.at"), F.col("p.many")).alias("ids")).agg(F.max("n").alias("most")))
    covered = F.col("most").isNotNull() & (exact("most") * COVERED[1] >= exact("a") * COVERED[0])
    left = scored.join(longer, "ids", "left").where(~covered).drop("most")

    spelt = (left.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
             .groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"), F.first("lang").alias("lang"))
             .select("ids", "lang", F.array_join("w.word", " ").alias("phrase")))
    rows = left.join(spelt, "ids").select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of many parts of a language first, so that no task ranks all of it.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
