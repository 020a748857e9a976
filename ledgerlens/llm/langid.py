"""Language identification by a byte convolutional network.

Filters of several widths run over a window's bytes (a filter is a table of
weights by position and byte), the maximum over the window is pooled, and a
softmax over the pooled values gives the language.  Trained in numpy on a
bounded sample of distinct labelled texts of every language; applied to all windows
of whole texts, whose probabilities are averaged by length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import text_bytes

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 256
#: Sample to train on: distinct texts of each language and of all (but one of each
#: language at the least), and bytes of a text, in windows drawn from the whole.
TEXTS, SAMPLE, DRAWN = 300, 60_000, 2048
STEPS, BATCH, RATE = 300, 64, 0.03
#: Languages that FILTERS and STEPS are meant for; more get multiples of both.
CROWD = 40
PAD = 256
#: Bytes of text handled at once.
STEP = 1 << 20
UNKNOWN = "und"


class Network:
    """Weights: one table (position, byte, filter) per width, and the softmax layer."""

    def __init__(self, n_out: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.filters = FILTERS * _crowds(n_out)
        self.tables = [rng.normal(0, 0.3, (w, PAD + 1, self.filters)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * self.filters, n_out)).astype(np.float32)
        self.bias = np.zeros(n_out, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, self.out, self.bias]

    def pooled(self, x: np.ndarray, where: bool = False):
        """Maxima of all filters over windows ``x`` (n, WINDOW), and their places."""
        best, places = [], []
        for table in self.tables:
            w = len(table)
            n = x.shape[1] - w + 1
            act = table[0][x[:, :n]]
            for k in range(1, w):
                act += table[k][x[:, k:k + n]]
            if where:
                at = act.argmax(axis=1)
                places.append(at)
                best.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
            else:
                best.append(act.max(axis=1))
        return np.concatenate(best, axis=1), places

    def pairs(self) -> list[list[tuple[int, np.ndarray]]]:
        """The tables for applying: (position, summed weights of the byte pair
        there), and of a single byte where the width is odd."""
        if not hasattr(self, "_pairs"):
            self._pairs = []
            for t in self.tables:
                two = [(k, (t[k][:, None] + t[k + 1][None]).reshape(-1, self.filters)) for k in range(0, len(t) - 1, 2)]
                self._pairs.append(two + [(len(t) - 1, t[-1])] * (len(t) % 2))
        return self._pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Like ``pooled``, but two bytes at a time and some windows at a time."""
        best = np.empty((len(x), len(self.tables) * self.filters), np.float32)
        for at in range(0, len(x), 32):
            part = x[at:at + 32].astype(np.int32)
            two = part[:, :-1] * (PAD + 1) + part[:, 1:]
            for i, (table, steps) in enumerate(zip(self.tables, self.pairs(), strict=True)):
                n = part.shape[1] - len(table) + 1
                act = None
                for k, weights in steps:
                    got = weights.take((part if len(weights) == PAD + 1 else two)[:, k:k + n], axis=0)
                    act = got if act is None else np.add(act, got, out=act)
                best[at:at + 32, i * self.filters:(i + 1) * self.filters] = act.max(axis=1)
        return _softmax(np.maximum(best, 0) @ self.out + self.bias)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        raw, places = self.pooled(x, where=True)
        h = np.maximum(raw, 0)
        d = _softmax(h @ self.out + self.bias)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.out.T) * (raw > 0)
        out = []
        rows = np.arange(len(x))[:, None]
        filters = np.arange(self.filters)[None, :]
        for i, (table, at) in enumerate(zip(self.tables, places, strict=True)):
            g = np.zeros_like(table)
            part = back[:, i * self.filters:(i + 1) * self.filters]
            for k in range(len(table)):
                np.add.at(g[k], (x[rows, at + k], np.broadcast_to(filters, at.shape)), part)
            out.append(g)
        return [*out, h.T @ d, d.sum(axis=0)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(text: bytes) -> np.ndarray:
    """The text in rows of WINDOW bytes, the last filled up."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def _crowds(languages: int) -> int:
    return -(-max(1, languages) // CROWD)


def drawn(text: bytes) -> bytes:
    """A text for training: the whole, or the windows, in order, that have the least hashes."""
    if len(text) <= DRAWN:
        return text
    pieces = [text[i:i + WINDOW] for i in range(0, len(text), WINDOW)]
    chosen = sorted(range(len(pieces)), key=lambda i: (zlib.crc32(pieces[i]), i))[:DRAWN // WINDOW]
    return b"".join(pieces[i] for i in sorted(chosen))


def train(texts: list[bytes], labels: list[str], seed: int = 0) -> tuple[Network, list[str]]:
    """A network and its languages (sorted), by Adam on windows, languages drawn evenly."""
    names = sorted(set(labels))
    number = {x: i for i, x in enumerate(names)}
    x = [windows(drawn(t)) for t in texts]
    y = np.concatenate([np.full(len(w), number[k]) for w, k in zip(x, labels, strict=True)])
    x = np.concatenate(x)
    net, rng = Network(len(names), seed), np.random.default_rng(seed)
    of = [np.flatnonzero(y == i) for i in range(len(names))]
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    steps = STEPS * _crowds(len(names))
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[i]) for i in rng.integers(0, len(names), BATCH)])
        batch = x[pick].copy()
        batch[np.arange(WINDOW) >= rng.integers(16, WINDOW + 1, BATCH)[:, None]] = PAD  # short texts occur too
        rate = RATE * (1 - step / (steps + 1))
        for w, g, m, v in zip(net.weights(), net.gradients(batch, y[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net, names


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[Network, list[str]] | None:
    """Train on a sample of ``labelled``; None if it has no labelled text with a letter.

    Every language takes part.  The hashes of its distinct texts choose its sample, so
    neither copies nor partitions change it; only the chosen texts are read whole, and
    only windows drawn from them reach the driver."""
    known = (labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
             .select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), text_bytes(labelled[text]).alias("body")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    heads = known.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= TEXTS).collect()
    if not heads:
        return None
    each = max(1, SAMPLE // len({r["lang"] for r in heads}))
    chosen = labelled.sparkSession.createDataFrame([(r["lang"], r["h"]) for r in heads if r["place"] <= each],
                                                   known.select("lang", "h").schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([drawn(t) for t in b.column(2).to_pylist()], pa.binary())],
                                             names=["lang", "h", "body"])

    part = known.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "body")
    kind = part.schema["lang"].dataType.simpleString()
    rows = sorted(part.mapInArrow(draw, f"lang {kind}, h long, body binary").dropDuplicates(["lang", "h"]).collect(),
                  key=lambda r: (r["h"], str(r["lang"])))
    return train([bytes(r["body"]) for r in rows], [r["lang"] for r in rows])


def _of_texts(texts: list[bytes], net: Network, names: list[str]) -> list[tuple[str, float]]:
    """Language and probability of each text, from all its windows by their lengths."""
    x = [windows(t) for t in texts]
    size = np.concatenate([np.minimum(WINDOW, len(t) - WINDOW * np.arange(len(w))) for t, w in zip(texts, x, strict=True)])
    p = net.probabilities(np.concatenate(x)) * size[:, None]
    cut = np.cumsum([0, *(len(w) for w in x[:-1])])
    p = np.add.reduceat(p.astype(np.float64), cut, axis=0) / np.array([len(t) for t in texts])[:, None]
    return [(names[k], float(min(1.0, row[k]))) for row, k in zip(p, p.argmax(axis=1), strict=True)]


def identify(docs: DataFrame, model: tuple[Network, list[str]] | None, text: str = "text",
             keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``), with
    ``lang_pred`` and ``score``, its probability (0 to 1).

    Null and empty texts and texts without a letter are ``und`` with score 0;
    so are all without a model.  Very long texts are read whole, in steps; repeated rows
    stay, with equal results; an empty table gives no rows, and columns of the input can't
    clash (they are in ``row``).
    """
    wanted = docs.select(F.struct(*(keep or ["*"])).alias("row"), text_bytes(docs[text]).alias("body"),
                         F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column(1).to_pylist()
            langs, scores = [UNKNOWN] * len(bodies), [0.0] * len(bodies)
            told = [i for i, t in enumerate(b.column(2).to_pylist()) if t and model is not None]
            while told:  # texts together, as far as they fit
                many, size = 1, len(bodies[told[0]])
                while many < len(told) and size + len(bodies[told[many]]) <= STEP:
                    size += len(bodies[told[many]])
                    many += 1
                for i, (k, score) in zip(told[:many], _of_texts([bodies[i] for i in told[:many]], *model), strict=True):
                    langs[i], scores[i] = k, score
                told = told[many:]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["row", "lang_pred", "score"])

    return wanted.mapInArrow(run, f"row {wanted.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def crc_fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds
