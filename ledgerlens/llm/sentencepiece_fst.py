"""SentencePiece BPE encoding and decoding by a weighted transducer.

Compiled from a model file:

* the normaliser: a dummy prefix and U+2581 for every space;
* the pieces: an arc for each, labelled with its characters and its id;
* byte fallback: an arc for any other character, with the ids of its bytes.

States remember the piece read last.  An arc weighs 0 after a piece that stays
apart from it and infinity after one with which merging would change either
(the merges of both together don't give just the two).  A sequence is what BPE
produces exactly if all neighbours stay apart, so the input composed with the
transducer has one path of finite weight, and the tropical-semiring shortest
path finds it, place by place.  Arc weights are worked out when first met.

A space never follows another character inside a piece, so texts are
composed word by word.  Paths of words met before are kept, and those met least
lately are forgotten: a corpus has no end of words.  A worker outlives its tasks,
so a task's end forgets all words' paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
#: Paths of words, paths of stretches inside words and weights of pairs of pieces that a worker
#: keeps, and as many met before those: the dearer to make again, the more.
WORDS, STRETCHES, PAIRS = 1 << 18, 1 << 17, 1 << 18
#: Bytes of text handled at once.
STEP = 1 << 20


class _Kept(dict):
    """Results by key.  When ``most`` are there they become the ones ``before``, from
    which a key met again comes back; those that they replace are forgotten."""

    def __init__(self, made, most: int):
        super().__init__()
        self.made, self.most, self.before = made, most, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out = self.made(key)
        if isinstance(key, int) or len(key) <= 64:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[key] = out
        return out


class Transducer:
    """Compiled from a SentencePiece BPE model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap
                or spec.remove_extra_whitespaces or not spec.escape_whitespaces):
            raise ValueError("only BPE models with byte fallback and a plain normaliser are compiled")
        self.prefix = spec.add_dummy_prefix
        normal = {1, 4}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in normal}
        self.scores = {p.piece: p.score for p in model.pieces if p.type in normal}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.arcs = {p[:n]: -1 for p in self.ids for n in range(1, len(p))} | self.ids  # by prefix
        # What each id gives back when decoding.
        self.raw = [p.piece.replace(SPACE, " ").encode() if p.type in normal else
                    bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" for p in model.pieces]
        self.names = [p.piece for p in model.pieces]
        self.apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.units = regex.compile(" *[^ ]+| +").findall
        self.stays = _Kept(self._finite, PAIRS)
        # No arc leads over a place whose two neighbours stand together in no piece.
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.atoms = _Kept(self._shortest, STRETCHES)
        self.paths = _Kept(self._path, WORDS)
        self.spaced = _Kept(lambda word: self._path(SPACE + word), WORDS)  # words after one space
        self.newline = self._shortest("\n")

    def _merged(self, text: str) -> list[str]:
        """Merges by best score, leftmost first: tells an arc's weight."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _finite(self, pair: int) -> bool:
        """Whether the arc of the piece in the lower 32 bits has weight 0 after
        the piece above them (-1: none)."""
        both = [self.names[i] for i in (pair >> 32, pair & 0xFFFFFFFF) if i >= 0]
        return self._merged("".join(both)) == both

    def _path(self, word: str) -> tuple[int, ...]:
        word = word.replace(" ", SPACE)
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.inside]
        if not cuts:
            return self._shortest(word)
        return tuple(chain.from_iterable(
            self.atoms[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)))

    def _shortest(self, word: str) -> tuple[int, ...]:
        """Ids on the path of finite weight through ``word``: depth first, the
        longest arc first.  Only one path of finite weight leads to any place,
        so a place without a way on is never entered again."""
        arcs, stays, end = self.arcs.get, self.stays, len(word)
        path: list = []  # (place, arcs not tried yet, piece that leads on)
        place, before, dead, todo = 0, -1, set(), None
        while place < end:
            if todo is None:  # walk the pieces' prefixes as far as they go
                todo, upto = [], place + 1
                while upto <= end:
                    piece = arcs(word[place:upto])
                    if piece is None:
                        break
                    if piece >= 0:
                        todo.append((upto, piece))
                    upto += 1
                if not todo and (place == upto - 1 or word[place] not in self.ids):
                    todo.append((place + 1, -1))
            while todo:
                upto, piece = todo.pop()
                if upto in dead:
                    continue
                if piece >= 0 and not stays[before << 32 | piece]:
                    continue
                path.append((place, before, todo, piece))
                place, before, todo = upto, piece, None
                break
            else:
                dead.add(place)
                place, before, todo, _ = path.pop()
        out = []
        for place, _, _, piece in path:
            if piece < 0:
                out.extend(self.bytes[b] for b in word[place].encode())
            else:
                out.append(piece)
        return tuple(out)

    def _line(self, line: str) -> list[tuple[int, ...]]:
        """The paths of a line's words."""
        words = line.split(" ")
        if not all(words[1:]):  # spaces in a row belong together
            return [self.paths[u] for u in self.units(line)]
        out = [self.paths[words[0]]] if words[0] else []
        out.extend(map(self.spaced.__getitem__, words[1:]))
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        text = text.replace(SPACE, " ")
        if self.prefix:
            text = " " + text
        if not self.apart:
            return np.array(self.paths[text], np.int32)
        lines = text.split("\n")
        found = self._line(lines[0])
        for line in lines[1:]:
            found.append(self.newline)
            found += self._line(line)
        return np.fromiter(chain.from_iterable(found), np.int32)

    def forget(self) -> None:
        """Lets go of the words' paths; what is dear to make again stays."""
        for kept in (self.paths, self.spaced):
            kept.clear()
            kept.before = {}

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str, text: str = "text", keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``), with
    ``ids`` (array of int), ``n_bytes`` of the text and ``round_trip``: whether decoding the ids gives the
    text back (U+2581 in a text reads as a space, which is all that can differ).

    Null and empty texts have no ids.  Repeated rows stay.
    """
    wanted = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.coalesce(docs[text], F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for b in batches:
            size = np.asarray(pa.compute.binary_length(b.column(1)), np.int64)
            step = np.cumsum(size) // STEP if len(size) else size
            cut = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(size)]))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                texts = b.column(1).slice(i, j - i).to_pylist()
                found = [fst.encode(t) for t in texts]
                same = [fst.decode(x.tolist()) == t.replace(SPACE, " ") for x, t in zip(found, texts, strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array(size[i:j]), pa.array(same, pa.bool_())],
                    names=["row", "ids", "n_bytes", "round_trip"])
        fst.forget()

    row = wanted.schema["row"].dataType.simpleString()
    return wanted.mapInArrow(run, f"row {row}, ids array<int>, n_bytes long, round_trip boolean")


def decode(encoded: DataFrame, model: str, ids: str = "ids", keep: list | None = None) -> DataFrame:
    """The rows of ``encoded`` (struct ``row``), with ``text``; null ids give null."""
    wanted = encoded.select(F.struct(*(keep or ["*"])).alias("row"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(model)
        for b in batches:
            texts = [None if x is None else fst.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return wanted.mapInArrow(run, f"row {wanted.schema['row'].dataType.simpleString()}, text string")
