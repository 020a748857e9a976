"""Quality classifier: ridge regression on random Fourier features.

Each text is reduced to a few document statistics (lengths, shares of character
classes, repetition).  Cosines of random projections of the standardised statistics
approximate a Gaussian kernel; every task sums its share of the normal equations,
and a ridge solution of the total gives raw scores.  Isotonic regression over a
histogram of the raw scores of texts that were not fitted turns them into
probabilities.

All labelled texts are fitted on, each distinct text once, without a bound: only
sums reach the driver (a matrix of FEATURES x FEATURES, a histogram of BINS).  Statistics
and cosines are rounded to whole numbers, so the order of the sums does not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import materialise, text_bytes, tree_sum

LIMIT = 0.3
#: Random features, kernel width in standard deviations, ridge per text, seed.
FEATURES, WIDTH, RIDGE, SEED = 512, 5.0, 1e-4, 11
#: Bins of the raw score that the calibration sees, from LOW to HIGH.
BINS, LOW, HIGH = 3000, -1.0, 2.0
#: One labelled text of PARTS is for the calibration.
PARTS = 4
#: Units a statistic and a cosine are rounded to.
UNIT, TURN = 1024, 4096

_CLASSES = (b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:", b"!?",
            b"\"'()[]-`", b"#$%&*+/<=>@\\^_{|}~", bytes(range(0xC0, 0x100)))
_REST, _INNER = len(_CLASSES), len(_CLASSES) + 1  # control characters, later bytes of a character
_CLASS = np.full(256, _REST, np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _k
_CLASS[0x80:0xC0] = _INNER

STATISTICS = (
    "log bytes", "log words", "log lines", "spaces", "line ends", "lower case", "upper case", "digits", "stops", "calls",
    "quotes and brackets", "symbols", "beyond ASCII", "controls", "log mean word", "log longest word", "spread of word lengths",
    "distinct words", "commonest word", "ten commonest words", "words that echo the one before", "distinct word pairs",
    "repeated lines", "log words a line")


def statistics(text: bytes) -> list[float]:
    """The values of STATISTICS of a whole text; an empty text has only zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    of = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=_INNER + 1)
    chars = max(1, len(text) - int(of[_INNER]))
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    common = Counter(words)
    top = [c for _, c in common.most_common(10)] or [0]
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), *(of[:_INNER] / chars),
            np.log1p(sizes.mean()), np.log1p(sizes.max()), min(sizes.std(), 100.0) / 10,
            len(common) / n, top[0] / n, sum(top) / n, sum(map(eq, words, words[1:])) / n,
            len(set(zip(words, words[1:]))) / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines)))]


def describe(docs: DataFrame, text: str = "text", keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``) with ``h``, a
    hash of the text, and ``x``, its statistics in whole UNITs.  A null text is empty.
    One pass over the texts; written to the scratch folder, for ``fit`` and ``score``."""
    wanted = docs.select(F.struct(*(keep or ["*"])).alias("row"), text_bytes(docs[text]).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
            hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes), _lists(np.rint(x * UNIT).astype(np.int32))],
                                             names=["row", "h", "x"])

    return materialise(wanted.mapInArrow(run, f"row {wanted.schema['row'].dataType.simpleString()}, h long, x array<int>"))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


@dataclass
class Model:
    """A fitted classifier.  ``raw`` is the ridge score, ``score`` the calibrated one."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shift: np.ndarray
    weights: np.ndarray = None
    raws: np.ndarray = None
    chances: np.ndarray = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Random features of rows of statistics, in whole TURNs; the last is constant."""
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        return np.column_stack([np.rint(TURN * np.cos(z @ self.waves + self.shift)), np.full(len(x), float(TURN))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.raws, self.chances)


def isotonic(at: np.ndarray, weight: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of hits / weight on rising ``at`` by pooling adjacent
    violators: centre and level of each pool."""
    pools: list[list[float]] = []  # weight, hits, weighted place
    for x, w, y in zip(at, weight, hits, strict=True):
        pools.append([float(w), float(y), float(w * x)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(described: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Model | None:
    """A model from the rows of ``describe`` (with ``id_col`` kept) that have a label 0
    or 1 in ``labels(id_col, label)``; None without any.

    Only narrow rows move, never texts.  Copies of a text are one row, with the
    label that more of them have; of several labels of one id the greatest counts."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("long").alias("__y")))
    rows = materialise(described.join(known, F.col(f"row.{id_col}") == F.col("__id"))
                       .groupBy("h", "x").agg((2 * F.sum("__y") >= F.count("__y")).alias("y")))

    def first(batches: Iterator[pa.RecordBatch]) -> list | None:
        x = [_matrix(b.column("x")).astype(np.int64) for b in batches if b.num_rows]
        return [np.array([sum(map(len, x))], object), *(sum(a.astype(object).sum(0) for a in (m ** p for m in x)) for p in (1, 2))] if x else None

    got = tree_sum(rows.select("x"), first)
    if got is None:
        return None
    n, total, squares = got[0][0], got[1], got[2]
    rng = np.random.default_rng(SEED)
    spread = np.array([max(1.0, (int(q) * n - int(s) ** 2) ** 0.5 / n) for s, q in zip(total, squares, strict=True)])
    model = Model(np.array([s / n for s in total], float), spread, rng.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES)),
                  rng.uniform(0, 2 * np.pi, FEATURES))

    # Hashes deal the texts; where that leaves one of the two without any, both take all.
    part = F.pmod("h", F.lit(PARTS)) == 0
    many = rows.agg(F.count(F.when(part, 1)), F.count(F.when(~part, 1))).first()
    apart = all(many)

    def normal(batches: Iterator[pa.RecordBatch]) -> list | None:
        total = None
        for b in batches:
            z, y = model.cosines(_matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False).astype(float)
            # Below 2**53, so that the sums of a batch are exact.
            own = [(z.T @ z).astype(np.int64), (z.T @ y).astype(np.int64), np.array([len(y)])]
            total = own if total is None else [a + c for a, c in zip(total, own, strict=True)]
        return total

    gram, target, count = tree_sum((rows.where(~part) if apart else rows).select("x", "y"), normal)
    gram = gram / (float(TURN) ** 2 * count[0])
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), target / (TURN * count[0])) / TURN

    def histogram(batches: Iterator[pa.RecordBatch]) -> list | None:
        total = None
        for b in batches:
            s = model.raw(_matrix(b.column("x")))
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            k = np.clip(((s - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            own = [np.bincount(k, minlength=BINS), np.bincount(k, y, minlength=BINS).astype(np.int64)]
            total = own if total is None else [a + c for a, c in zip(total, own, strict=True)]
        return total

    seen, hits = tree_sum((rows.where(part) if apart else rows).select("x", "y"), histogram)
    filled = np.flatnonzero(seen)
    model.raws, model.chances = isotonic(LOW + (filled + 0.5) * (HIGH - LOW) / BINS, seen[filled], hits[filled])
    return model


def score(described: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``describe`` (struct ``row``) with ``score``, 0 to 1, higher: label 1
    likelier.  Without a model every score is 0.5.  Null and empty texts are scored
    like any other, very long ones as a whole; repeated rows stay, with equal scores; an
    empty table gives no rows, and columns of the input can't clash (they are in ``row``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(_matrix(b.column(1))) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["row", "score"])

    told = described.select("row", "x")
    return told.mapInArrow(run, f"row {told.schema['row'].dataType.simpleString()}, score double")
