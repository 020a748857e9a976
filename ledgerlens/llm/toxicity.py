"""Toxicity by compression distance.

Two zstandard dictionaries, one trained on ordinary and one on toxic text.  The
toxic one is trained on the stretches of toxic texts that ordinary text can't explain: runs of
GRAM-byte strings that a share of the toxic texts hold and that are RARER times rarer in
ordinary ones.  (Trained on whole toxic texts, a dictionary fills up with the prose
that both share, and found 8 to 32 of 120 held-out toxic texts at sf0.1.)  Each window of a
text is compressed with both; what the toxic dictionary saves is the window's
distance.  A text's largest distances go through a logistic curve calibrated on
texts that neither dictionary was trained on; the calibration also chooses among shares
and sizes of the toxic dictionary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import materialise, text_bytes

#: Sample to train on: texts of either label, and bytes of each that are trained
#: on, drawn in windows from the whole text.  Calibration reads whole texts.
TOXIC, ORDINARY, BYTES, DRAWN = 1500, 3000, 4096, 512
#: Windows overlap, so that no word is cut in all windows.
WINDOW, OVERLAP = 96, 16
ORDINARY_SIZE = 8192
#: What tells toxic text: strings of GRAM bytes, the least shares of toxic texts that hold them
#: (a low one takes in the insults of a small language, but also what chance repeats), and how
#: much rarer they are in others.
GRAM, SHARES, RARER = 6, (0.05, 0.035, 0.025), 5
#: Sizes of the toxic dictionary and of the segments that zstandard's training chooses.
SIZES, SEGMENTS = (512, 1024), (16, 24)
LIMIT = 0.3
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def plain(text: bytes) -> bytes:
    """ASCII lower case, words apart by single spaces."""
    return b" " + b" ".join(text.translate(_LETTERS).split()) + b" "


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    # Six bytes are a short word and the spaces around it: shorter matches are chance.
    told = zstd.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=14, search_log=6, min_match=6, target_length=16,
        strategy=zstd.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstd.ZstdCompressor(compression_params=told,
                               dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2))
    bias: float = 0.0

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def pair(self) -> tuple:
        """Compressors with the ordinary dictionary and with both."""
        if self._pair is None:
            # The ordinary dictionary lies next to the window in both, so only the rest differs.
            self._pair = _compressor(self.ordinary).compress, _compressor(self.toxic + self.ordinary).compress
        return self._pair

    def features(self, text: bytes) -> tuple[float, float]:
        return features([self], text)[0]

    def score(self, text: bytes) -> float:
        z = float(self.weights @ np.array(self.features(text))) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def features(models: list[Model], text: bytes) -> list[tuple[float, float]]:
    """For each model (all of one ordinary dictionary) the largest distance among the
    text's windows, and the next two together; a distance is how many bytes the toxic
    dictionary saves."""
    body, step = plain(text), WINDOW - OVERLAP
    parts = [body[i:i + WINDOW] for i in range(0, max(1, len(body) - OVERLAP), step)]
    ordinary = [len(models[0].pair()[0](w)) for w in parts]
    out = []
    for m in models:
        toxic = m.pair()[1]
        top = sorted((n - len(toxic(w)) for n, w in zip(ordinary, parts, strict=True)), reverse=True)[:3]
        out.append((max(0, top[0]), sum(max(0, t) for t in top[1:])))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias, by Newton steps with a slight ridge."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(len(w))
        w -= np.linalg.solve(hess, a.T @ (p - y) + 0.01 * w)
    return w[:-1], float(w[-1])


def _codes(text: bytes) -> np.ndarray:
    """All GRAM-byte strings of a text, as whole numbers."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(b) - GRAM + 1)
    return sum(b[k:k + n] << np.uint64(8 * k) for k in range(GRAM))


def _stretches(text: bytes, telling: np.ndarray) -> set[bytes]:
    """The runs of ``text`` that consist of strings in ``telling`` (sorted codes)."""
    codes = _codes(text)
    if not len(codes) or not len(telling):
        return set()
    at = np.searchsorted(telling, codes)
    hit = telling[np.minimum(at, len(telling) - 1)] == codes
    cover = np.zeros(len(text) + 2, np.int8)
    for k in range(GRAM):
        cover[1 + k:1 + k + len(hit)] |= hit
    edge = np.flatnonzero(np.diff(cover))
    return {text[a:b] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)}


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    try:
        return zstd.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstd.ZstdError:  # too little text to train on: its end serves as it is
        return b"".join(samples)[-size:]


def _candidates(good: list[bytes], bad: list[bytes]) -> list[Model]:
    """Models from plain ordinary and toxic texts, one for each share, size and segment, not yet calibrated."""
    ordinary = _trained(ORDINARY_SIZE, [t[i:i + 512] for t in good for i in range(0, len(t), 512)], 64, 8)
    bad = list(dict.fromkeys(bad))  # copies of one text are no more evidence
    held = [np.unique(_codes(t)) for t in bad]
    codes, toxic = np.unique(np.concatenate(held), return_counts=True)
    often = toxic >= max(2, min(SHARES) * len(bad))
    codes, toxic = codes[often], toxic[often]
    other = np.zeros(len(codes))
    for t in good:
        own = np.unique(_codes(t))
        at = np.searchsorted(own, codes)
        other += (own[np.minimum(at, len(own) - 1)] == codes) if len(own) else 0
    rare = toxic / len(bad) > RARER * (other + 0.5) / max(1, len(good))
    found: dict[bytes, None] = {}
    for share in SHARES:
        telling = codes[rare & (toxic >= max(2, share * len(bad)))]
        samples = [x for t in bad for x in sorted(_stretches(t, telling))]
        for size in SIZES:
            for k in SEGMENTS:
                found[_trained(size, samples, k, GRAM)] = None
    return [Model(ordinary, t) for t in found]


def _best(models: list[Model], features: np.ndarray, y: np.ndarray) -> Model:
    """The model that tells the calibration texts best, calibrated;
    ``features`` has for each text those of each model."""
    def calibrated(i: int) -> tuple[float, int]:
        m, x = models[i], features[:, i].reshape(len(y), 2)
        m.weights, m.bias = _logistic(x, y)
        z = np.clip(x @ m.weights + m.bias, -30, 30)
        return float(np.sum(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))), i

    return models[min(calibrated(i) for i in range(len(models)))[1]]


def train(texts: list[bytes], labels: list[int]) -> Model:
    """Dictionaries from two texts of three, calibration on the third."""
    part = [([], []), ([], [])]  # ordinary, toxic: (to train, to calibrate)
    for t, y in zip(texts, labels, strict=True):
        own = part[int(y)]
        own[len(own[0]) + len(own[1]) and (len(own[0]) + len(own[1])) % 3 == 2].append(t)
    models = _candidates(*([plain(t) for t in p[0]] for p in part))
    rest = part[0][1] + part[1][1]
    x = np.array([features(models, t) for t in rest], float).reshape(len(rest), len(models), 2)
    return _best(models, x, np.repeat([0.0, 1.0], [len(part[0][1]), len(part[1][1])]))


def drawn(text: bytes) -> bytes:
    """A plain text for training: the whole, or the windows of DRAWN bytes, in
    order and without words cut at their edges, that have the least hashes."""
    body = plain(text)
    if len(body) <= BYTES:
        return body
    pieces = [body[i:i + DRAWN] for i in range(0, len(body), DRAWN)]
    chosen = sorted(sorted(range(len(pieces)), key=lambda i: (zlib.crc32(pieces[i]), i))[:BYTES // DRAWN])
    # What lies between the outer spaces; a piece without two spaces is part of one long word.
    return b" " + b" ".join(p[p.index(b" "):p.rindex(b" ")].strip() for p in (pieces[i] for i in chosen) if p.count(b" ") > 1) + b" "


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        label: str = "toxic") -> Model | None:
    """Train on a bounded sample of ``docs`` with a label 0 or 1 in
    ``labels(id_col, label)``; None if either label is missing.

    The ids' hashes choose the sample among the labels, so only the chosen
    texts move: at most ORDINARY + TOXIC ids meet the documents.  Two texts of three
    are trained on, by windows drawn from the whole text; the third is
    calibrated on as whole texts, whose features are computed in Spark's tasks."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("__label"))
    chosen = [known.where(F.col("__label") == y).orderBy(F.xxhash64(id_col), id_col).limit(most)
              for y, most in ((0, ORDINARY), (1, TOXIC))]
    texts = materialise(docs.where(F.col(text).isNotNull()).join(F.broadcast(chosen[0].union(chosen[1])), id_col)
                        .select(F.col("__label").cast("int").alias("y"), F.xxhash64(text).alias("h"), text_bytes(docs[text]).alias("body"))
                        .dropDuplicates(["y", "h"]))
    keys = [(r["y"], r["h"]) for r in texts.select("y", "h").orderBy("h", "y").limit(ORDINARY + TOXIC).collect()]
    of = [[h for y, h in keys if y == label_] for label_ in (0, 1)]
    if not of[0] or not of[1]:
        return None
    spark = docs.sparkSession
    roles = [(y, h, i % 3 == 2) for y in (0, 1) for i, h in enumerate(of[y])]
    part = texts.join(F.broadcast(spark.createDataFrame(roles, "y int, h long, rest boolean")), ["y", "h"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([drawn(x) for x in b.column(2).to_pylist()], pa.binary())],
                                             names=["y", "h", "body"])

    own = part.where("not rest").select("y", "h", "body").mapInArrow(draw, "y int, h long, body binary").collect()
    good, bad = ([bytes(r["body"]) for r in sorted(own, key=lambda r: r["h"]) if r["y"] == y] for y in (0, 1))
    models = _candidates(good, bad)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [[float(v) for f in features(models, t) for v in f] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "h", "x"])

    rest = sorted(part.where("rest").select("y", "h", "body").mapInArrow(told, "y int, h long, x array<double>").collect())
    x = np.array([r["x"] for r in rest], float).reshape(len(rest), len(models), 2)
    return _best(models, x, np.array([r["y"] for r in rest], float))


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``), with
    ``score`` (0 to 1, higher: likelier toxic).

    Null and empty texts are one empty window and get the score of no distance;
    without a model every score is 0.  Very long texts are compressed window by window as a
    whole; repeated rows stay, with equal scores; an empty table gives no rows, and columns of the
    input can't clash (they are in ``row``).
    """
    wanted = docs.select(F.struct(*(keep or ["*"])).alias("row"), text_bytes(docs[text]).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(x) if model else 0.0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return wanted.mapInArrow(run, f"row {wanted.schema['row'].dataType.simpleString()}, score double")
