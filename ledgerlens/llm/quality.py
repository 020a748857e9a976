"""Quality rules as a short-circuit cascade.

A rule rejects texts by a few counts.  On a bounded sample each rule's cost
(seconds a text) and selectivity (share rejected) are measured, and the rules
run in the order of rejections per second: a text that one rejects is never
measured for the next.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import text_bytes

WINDOW = 8
#: Texts the costs and selectivities are estimated on.
SAMPLE = 400
#: Bytes of text measured at once.
STEP = 1 << 20


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _table(b" \t\n\x0b\x0c\r")
_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_INNER = _table(bytes(range(0x80, 0xC0)))  # UTF-8 continuation


class Measures:
    """Counts of a list of texts (UTF-8 bytes), each made when first asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts, self._made = texts, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = getattr(self, "_" + name)()
        return self._made[name]

    def take(self, which: np.ndarray) -> Measures:
        out = Measures([self.texts[i] for i in which])
        out._made = {k: v[which] for k, v in self._made.items() if isinstance(v, np.ndarray) and len(v) == len(self.texts) and k[0] != "*"}
        return out

    def _count(self, table: np.ndarray) -> np.ndarray:
        if "*bytes" not in self._made:
            sizes = np.array([len(t) for t in self.texts], np.int64)
            self._made["*bytes"] = np.frombuffer(b"".join(self.texts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))
        buf, cuts = self._made["*bytes"]
        total = np.concatenate(([0], np.cumsum(table[buf], dtype=np.int64)))
        return total[cuts[1:]] - total[cuts[:-1]]

    def _ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word (equal words, equal numbers), and its text."""
        if "*ids" not in self._made:
            words = [t.split() for t in self.texts]
            number: dict = defaultdict(count().__next__)  # no cycle: the words go with it, not with the next full collection
            many = np.array([len(w) for w in words], np.int64)
            ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(many.sum()))
            self._made["*ids"] = ids, np.repeat(np.arange(len(words)), many), many
        return self._made["*ids"]

    def _n_words(self) -> np.ndarray:
        return self._ids()[2]

    def _word_chars(self) -> np.ndarray:
        """Code points in words: every byte but continuations and white space."""
        return self._count(~(_INNER | _SPACE))

    def _n_symbols(self) -> np.ndarray:
        return self._count(_SYMBOL)

    def _n_upper(self) -> np.ndarray:
        return self._count(_UPPER)

    def _n_letters(self) -> np.ndarray:
        return self._count(_LETTER)

    def _lines(self) -> list[list[bytes]]:
        if "*lines" not in self._made:
            self._made["*lines"] = [[x for x in t.split(b"\n") if x.strip()] for t in self.texts]
        return self._made["*lines"]

    def _n_lines(self) -> np.ndarray:
        return np.array([len(x) for x in self._lines()], np.int64)

    def _n_dup_lines(self) -> np.ndarray:
        return np.array([len(x) - len(set(x)) for x in self._lines()], np.int64)

    def _n_echoes(self) -> np.ndarray:
        """Words equal to the one before."""
        ids, text, _ = self._ids()
        again = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
        return np.bincount(text[1:][again], minlength=len(self.texts))

    def _n_repeat_words(self) -> np.ndarray:
        """Words in windows of WINDOW words that the text holds twice or more."""
        ids, text, _ = self._ids()
        n = len(ids) - WINDOW + 1
        if n < 2:
            return np.zeros(len(self.texts), np.int64)
        key = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        width = 1
        while width < WINDOW:
            key = (key[:-width] * np.uint64(0xBF58476D1CE4E5B9)) ^ (key[width:] + (key[width:] >> np.uint64(29)))
            width *= 2
        key = key * np.uint64(0x94D049BB133111EB) + text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(text[WINDOW - 1:] == text[:n])
        at = at[np.argsort(key[at], kind="stable")]
        same = np.flatnonzero(key[at[1:]] == key[at[:-1]])
        for j in range(WINDOW):  # the hash only proposes
            if not (ids[at[same] + j] == ids[at[same + 1] + j]).all():
                at = np.flatnonzero(text[WINDOW - 1:] == text[:n])
                cols = [ids[at + i] for i in range(WINDOW)] + [text[at]]
                order = np.lexsort(cols)
                at = at[order]
                same = np.flatnonzero(np.all([c[order][1:] == c[order][:-1] for c in cols], axis=0))
                break
        edge = np.zeros(len(ids) + 1, np.int64)
        twice = np.unique(np.concatenate([at[same], at[same + 1]]))
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=len(self.texts))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the Measures of some texts and returns a truth value for each."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


BASE = (
    Rule("short", lambda m: m["n_words"] < 20),
    Rule("repetitive", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("echoes", lambda m: 100 * m["n_echoes"] > 30 * m["n_words"]),
    Rule("lines", lambda m: 10 * m["n_dup_lines"] > 6 * m["n_lines"]),
    Rule("shouting", lambda m: 2 * m["n_upper"] > m["n_letters"]),
    Rule("long_words", lambda m: m["word_chars"] > 30 * m["n_words"]),
)


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
                sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules by rejections per second on at most ``sample`` texts."""
    texts = [bytes(r[0]) for r in docs.select(text_bytes(docs[text])).sample(0.1, seed=1).limit(sample).collect()]
    if not texts:
        return tuple(rules)
    worth = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = rule.rejects(Measures(texts)).mean()
        worth[rule.name] = rejected / max(time.perf_counter() - began, 1e-9)
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def cascade(measures: Measures, rules: tuple[Rule, ...]) -> np.ndarray:
    """For each text the place of the first rule that rejects it, or -1."""
    failed = np.full(len(measures.texts), -1)
    alive, left = np.arange(len(failed)), measures
    for k, rule in enumerate(rules):
        bad = np.asarray(rule.rejects(left), bool)
        failed[alive[bad]] = k
        if bad.any():
            alive, left = alive[~bad], left.take(np.flatnonzero(~bad))
        if not len(alive):
            break
    return failed


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ordered: bool = False,
          report: tuple[str, ...] = (), keep: list | None = None) -> DataFrame:
    """The rows of ``docs`` (struct ``row``, of the columns ``keep``), with the
    measures ``report`` (long, made for every text) and ``rejected_by``, the first rule
    that rejects the text, null for texts that all rules keep.

    Which of several rejecting rules is named depends on the measured order;
    whether one does, never.  Null and empty texts have no words: all measures
    are zero, so the rule ``short`` rejects them.  Repeated rows stay, each
    with its own result.
    """
    rules = tuple(rules) if ordered else order_rules(docs, text, rules)
    # A whole row holds its text already, and is sent with no second copy of it.
    inside = docs.columns.index(text) if not keep and dict(docs.dtypes).get(text) == "string" else None
    wanted = docs.select(F.struct(*(keep or ["*"])).alias("row"), *([text_bytes(docs[text]).alias("body")] if inside is None else []))
    names = [None, *(r.name for r in rules)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(1) if inside is None else pa.compute.fill_null(b.column(0).field(inside).cast(pa.binary()), b"")
            size = np.asarray(pa.compute.binary_length(body), np.int64)
            step = np.cumsum(size) // STEP if len(size) else size
            cut = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(size)]))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                m = Measures(body.slice(i, j - i).to_pylist())
                made = [pa.array(m[x], pa.int64()) for x in report]
                by = pa.array([names[k + 1] for k in cascade(m, rules)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *made, by], names=["row", *report, "rejected_by"])

    schema = f"row {wanted.schema['row'].dataType.simpleString()}, {''.join(f'{x} long, ' for x in report)}rejected_by string"
    return wanted.mapInArrow(run, schema)
