"""Quality classifier, collocations and whitening against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import collocations, quality_classifier, queries, whitening
from ledgerlens.llm.common import tree_sum

SF = "/root/testdata/sf0.01"


def check_columns(out, df):
    assert out.select("row.*").columns == df.columns
    assert {r[0] for r in out.select("row.fp").collect()} <= {"mine"}


def test_tree_sums(spark):
    def partial(batches):
        x = [b.column(0).to_numpy() for b in batches if b.num_rows]
        return [np.array([sum(map(len, x))]), np.concatenate(x).sum(keepdims=True)] if x else None

    n, total = tree_sum(spark.range(0, 1000, 1, 100), partial, fan=4)
    assert (n[0], total[0]) == (1000, 499500)
    assert tree_sum(spark.range(0, 1, 1, 70), partial)[0][0] == 1  # tasks without rows
    assert tree_sum(spark.range(0), partial) is None


# ------------------------------------------------------------------ 11
def test_isotonic_is_the_minimax_average():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(1, 25)
        weight = rng.integers(1, 6, n)
        hits = np.array([rng.integers(0, w + 1) for w in weight])
        at, level = quality_classifier.isotonic(np.arange(n, dtype=float), weight, hits)
        want = [max(min(hits[j:k + 1].sum() / weight[j:k + 1].sum() for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        assert sorted(set(np.round(level, 9))) == sorted(set(np.round(want, 9)))
        assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all()


def test_statistics():
    names = quality_classifier.STATISTICS
    assert quality_classifier.statistics(b"") == [0.0] * len(names)
    got = dict(zip(names, quality_classifier.statistics("ab ab Äb!\nab ab Äb!\n$$ 1".encode()), strict=True))
    assert got["log words"] == np.log1p(8) and got["distinct words"] == 4 / 8 and got["commonest word"] == 4 / 8
    assert got["repeated lines"] == pytest.approx(1 / 3) and got["words that echo the one before"] == 2 / 8
    assert got["symbols"] == 2 / 24 and got["beyond ASCII"] == 2 / 24 and got["calls"] == 2 / 24


def labelled(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = [rng.choice(["river", "stone", "bright", "morning", "letters"]) + rng.choice(["", "s", "."]) for _ in range(rng.randint(15, 80))]
        rows.append((i, " ".join(w + "##" if i % 4 == 0 else w for w in words), int(i % 4 != 0)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_classifier_is_ridge_on_the_features(spark):
    rows, df = labelled(spark)
    described = quality_classifier.describe(df, keep=["doc_id"])
    model = quality_classifier.fit(described, df.select("doc_id", "quality"))
    x, y, h = (np.array(v) for v in zip(*[(r.x, rows[r.doc_id][2], r.h) for r in described.select("x", "row.doc_id", "h").collect()], strict=True))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, np.maximum(1, x.std(0)))
    fitted = h % quality_classifier.PARTS != 0
    z = model.cosines(x[fitted].astype(float)) / quality_classifier.TURN
    gram = z.T @ z / len(z) + quality_classifier.RIDGE * np.eye(z.shape[1])
    assert np.allclose(model.weights * quality_classifier.TURN, np.linalg.solve(gram, z.T @ y[fitted] / len(z)), atol=1e-6)
    got = {r.doc_id: r.score for r in quality_classifier.score(described, model).select("row.doc_id", "score").collect()}
    assert sum((got[i] >= 0.3) == bool(q) for i, _, q in rows) >= 0.97 * len(rows)


def test_copies_are_no_more_evidence(spark):
    _, df = labelled(spark, 120)
    copies = df.where("doc_id = 0").crossJoin(spark.range(1000, 1300).withColumnRenamed("id", "new")).select(
        F.col("new").alias("doc_id"), "text", "quality")
    models = [quality_classifier.fit(quality_classifier.describe(d, keep=["doc_id"]), d.select("doc_id", "quality"))
              for d in (df, df.union(copies).repartition(5))]
    assert np.array_equal(models[0].weights, models[1].weights) and np.array_equal(models[0].chances, models[1].chances)


def test_classifier_rows(odd, empty):
    described = quality_classifier.describe(odd)
    labels = odd.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    for model in (quality_classifier.fit(described, labels), quality_classifier.fit(described, labels.where("quality = 1")), None):
        out = quality_classifier.score(described, model)
        check_columns(out, odd)
        scores = [r.score for r in out.select("score").collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality_classifier.fit(described, labels.withColumn("quality", F.lit(None).cast("int"))) is None
    assert quality_classifier.fit(described, labels.limit(0)) is None
    assert quality_classifier.score(quality_classifier.describe(empty), None).count() == 0


def test_quality_query(spark):
    got = queries.QUERIES["op11_quality_classifier"](spark, SF).toPandas()
    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.95


# ------------------------------------------------------------------ 12
def brute_phrases(docs, least, best=2000):
    counts = {}
    for text, lang in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            own = counts.setdefault(lang or "und", Counter())
            own.update(tuple(words[i:i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        rows = []
        for g, a in cand.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            inside = [c for big, c in cand.items() if len(big) > len(g) and any(big[i:i + len(g)] == g for i in range(len(big)))]
            if not any(100 * c >= 80 * a for c in inside):
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def found(df, **options):
    out = collocations.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("shard_bytes", [1 << 24, 300])
def test_collocations(spark, shard_bytes):
    rng = random.Random(3)
    words, signs = ["a", "b", "c", "Dd", "ee", "ä", "x\x00y", "rare"], [" "] * 12 + ["  ", "\t", ".", ", ", "\n", "? "]
    docs = [("".join(rng.choices(words, [9, 6, 5, 4, 3, 2, 1, 0.1])[0] + rng.choice(signs) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "en", "de", None])) for _ in range(150)]
    docs += [("New York city hall is new york city hall", "en")] * 40 + [(None, "en"), ("", None), (" .,\t", "zz"), ("one " * 3000, "one")]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    for least, best in ((5, 2000), (30, 7)):
        assert found(df, least=least, best=best, shard_bytes=shard_bytes) == brute_phrases(docs, least, best)


def test_index_intervals():
    rng = np.random.default_rng(4)
    text = np.concatenate([[0], rng.integers(0, 5, 400), [0]])
    index = collocations.Index(collocations.bwt(text), np.arange(100, 105))
    for depth in range(2, 5):
        starts, counts = index.extend()
        got = dict(zip(zip(*(c.tolist() for c in index.phrases(starts, depth))), counts.tolist(), strict=True))
        want = Counter(tuple(99 + text[i:i + depth]) for i in range(len(text) - depth + 1) if text[i:i + depth].all())
        assert got == want
    assert len(collocations.Index(collocations.bwt(np.zeros(2, int)), np.zeros(0)).extend()[0]) == 0


def test_collocations_odd(odd, empty):
    docs = [(r.text, r.lang) for r in odd.select("text", "lang").collect()]
    assert found(odd, least=2) == brute_phrases(docs, 2)
    assert found(empty) == []


# ------------------------------------------------------------------ 13
def brute_whitening(vectors, k=4):
    width = max(len(v) for v in vectors)
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, s = len(fit), fit.sum(0)
    c = (fit - s / n).astype(float)
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    real = values > width * np.finfo(float).eps * values[0]
    values, axes = values[real], axes[:, real]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n).astype(float) @ axes / np.sqrt(values), values / np.einsum("ij,ij->", c, c) * n


def check_whitening(df, vectors, ids):
    clean = whitening.cleaned(df)
    model = whitening.fit(clean)
    n, deviation, white, explained = brute_whitening(vectors)
    rows = whitening.whiten(clean, model).select("row.vec_id", "component", F.col("n").alias("m"), "deviation", "whitened", "explained", "identity_error").collect()
    assert len(rows) == white.size and model.n == n and model.identity_error <= 1e-4
    place = {i: k for k, i in enumerate(ids)}
    for r in rows:
        k = place[r.vec_id]
        assert (r.m, r.deviation) == (n, min(2 ** 63 - 1, deviation[k]))
        assert abs(r.whitened) == pytest.approx(abs(white[k, r.component - 1]), rel=1e-7, abs=1e-7)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error == model.identity_error
    for a in range(1, white.shape[1] + 1):  # one sign for all rows
        mine = [r.whitened * white[place[r.vec_id], a - 1] for r in rows if r.component == a and abs(r.whitened) > 1e-6]
        assert all(m > 0 for m in mine) or all(m < 0 for m in mine)


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 1, (400, 12)) * np.arange(1, 13) ** 0.7 + 3).tolist()
    vectors += [vectors[0]] * 150 + [[-0.0] * 12]  # copies count once in the fit
    bad = [(9001, None), (9002, [1.0, None]), (9003, [float("nan")]), (9004, [float("-inf")])]
    df = spark.createDataFrame([(i, v, "mine") for i, v in enumerate(vectors)] + [(*b, "mine") for b in bad],
                               "vec_id long, embedding array<double>, n string").repartition(5)
    check_whitening(df, vectors, range(len(vectors)))


def test_whitening_of_few_large_and_uneven(spark):
    vectors = [[1e12, 2.0, 0.5], [-3e11], [], [4.0, 1e10], [4.0, 1e10]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    check_whitening(df, vectors, range(5))
    for few in (df.limit(0), df.where("vec_id = 2"), df.where("vec_id = 0"), df.where("vec_id > 2")):  # nothing varies
        clean = whitening.cleaned(few)
        assert whitening.whiten(clean, whitening.fit(clean)).count() == 0
    lost = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 3.0]), (1, [5.0, 1.0])], "vec_id long, embedding array<float>")
    clean = whitening.cleaned(lost)
    assert whitening.whiten(clean, whitening.fit(clean)).where("row.vec_id is null").count() == 4


@pytest.mark.parametrize("width, values", [(1, [3]), (5, [2, 2, 2, 1, 0]), (60, np.linspace(1, 2, 60)), (80, 0.8 ** np.arange(80)),
                                           (90, [7] * 6 + [1] * 84), (4, [0, 0, 0, 0])])
def test_jacobi_davidson(width, values):
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(width, width)))[0]
    v = (q * np.array(values, float)) @ q.T
    got, axes, norms = whitening.eigenpairs(lambda z: v @ z, width, 4)
    want = np.sort(values)[::-1][:4]
    assert np.allclose(got, want, rtol=0, atol=1e-13 * max(1, want[0]))
    assert np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-12
    assert np.linalg.norm(v @ axes - axes * got, axis=0).max() <= 1e-12 * max(1, want[0])


def test_whitening_query(spark):
    got = queries.QUERIES["op13_whitening"](spark, SF).toPandas()
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    n, deviation, white, explained = brute_whitening([v.astype(float) for v in table.embedding])
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert np.allclose(np.abs(wide), np.abs(white), atol=1e-9) and (got.n == n).all()
    assert (got[got.component == 1].set_index("vec_id").deviation.loc[table.vec_id] == deviation).all()
    assert np.allclose(got.groupby("component").explained.first(), explained) and got.identity_error.nunique() == 1
