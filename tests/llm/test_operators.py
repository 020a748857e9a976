"""Each operator against a brute-force version, on test tables and odd rows."""

import gc
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import (components, langid, mixing, quality, sentencepiece_fst, simhash, suffix_array, suffix_dedup,
                            tokens, topk, toxicity, urls)

BPE, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def rows(df):
    return df.select("doc_id", "text", "source").collect()


def check_columns(out, df):
    """The operator carries every column of its input unharmed."""
    assert out.select("row.*").columns == df.columns
    if "fp" in df.columns:
        assert {r[0] for r in out.select("row.fp").collect()} <= {"mine"}


# ------------------------------------------------------------------ 1
def counts(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_quality(name, request):
    df = request.getfixturevalue(name)
    out = quality.judge(df, report=REPORT)
    check_columns(out, df)
    got = sorted(tuple(r) for r in out.select(*REPORT).collect())
    assert got == sorted(counts(r.text) for r in rows(df))
    for r in out.collect():
        assert (r.rejected_by is not None) >= (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_quality_verdict_never_depends_on_the_order(documents):
    texts = [(r.text or "").encode() for r in rows(documents)]
    whole = {r.name: r.rejects(quality.Measures(texts)) for r in quality.RULES}
    for seed in range(5):
        order = list(quality.RULES)
        random.Random(seed).shuffle(order)
        failed = quality.cascade(quality.Measures(texts), tuple(order))
        assert ((failed >= 0) == np.any(list(whole.values()), axis=0)).all()
        assert all(whole[order[k].name][i] for i, k in enumerate(failed) if k >= 0)


def test_quality_leaves_no_words_behind():
    """What a batch held goes with it, not with some later full collection."""
    texts = [b" ".join(b"word%d" % (i * 31 % 997) for i in range(n)) for n in range(5, 300)]
    gc.collect()
    gc.disable()
    gc.set_debug(gc.DEBUG_SAVEALL)
    try:
        quality.cascade(quality.Measures(texts), quality.RULES)
        gc.collect()
        left = [x for x in gc.garbage if isinstance(x, dict) and b"word31" in x]
    finally:
        gc.set_debug(0)
        gc.garbage.clear()
        gc.enable()
    assert not left


def test_quality_sends_a_whole_row_with_one_text(spark):
    long = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, long, "c"), (4, "\u00e9 " + long, None), (3, long, "c")], "doc_id long, text string, source string")
    whole, some = quality.judge(df, report=REPORT, ordered=True), quality.judge(df, report=REPORT, ordered=True, keep=["doc_id"])
    measured = [*REPORT, "rejected_by"]
    assert sorted(whole.select("row.doc_id", *measured).collect(), key=str) == sorted(some.select("row.doc_id", *measured).collect(), key=str)
    assert sorted(whole.select("row.*").collect(), key=str) == sorted(df.collect(), key=str)
    made = [f.dataType.simpleString() for f in whole.schema]
    assert made[0] == "struct<doc_id:bigint,text:string,source:string>"
    assert "binary" not in whole._jdf.queryExecution().optimizedPlan().toString()


# ------------------------------------------------------------------ 2
def brute_top(vectors, queries, k):
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    out = []
    for q, _ in queries:
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (5, 8))
    vectors = [(i, (centres[i % 5] + rng.normal(0, 0.2, 8)).tolist()) for i in range(600)]
    vectors += [(600 + i, vectors[0][1]) for i in range(80)]  # many equal vectors: ties
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>")
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), 5)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect())
    assert got == brute_top(vectors, [v for v in vectors if v[0] % 50 == 0], 5)


def test_top_k_few_large_and_uneven(spark):
    rows_ = [(0, [1e12, 2.0]), (50, [-3e11]), (7, []), (7, [])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()}
    assert got == {(0, 7): 0, (50, 7): 0, (0, 50): -2 ** 63, (50, 0): -2 ** 63}
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_search_over_trees_is_exact():
    rng = np.random.default_rng(2)
    points = np.floor(256 * rng.normal(0, 1, (2000, 6)))
    ids = rng.permutation(2000)
    tree = topk.cover_tree(ids, points)
    for node, kids in enumerate(tree.kids):  # nodes cover their rows, children part them
        gap = np.linalg.norm(points[tree.rows[node]] - tree.centres[node], axis=1)
        assert gap.max() <= tree.radii[node] + 1e-9
        assert not kids or sorted(np.concatenate([tree.rows[x] for x in kids])) == sorted(tree.rows[node])
    at, who, score = topk.search(topk.cover_tree(ids[:50], points[:50]), tree, 5)
    want = points[:50] @ points.T
    for i in range(50):
        best = sorted((-s, j) for s, j in zip(want[i], ids) if j != ids[i])[:5]
        assert [(-s, j) for s, j in zip(score[at == i], who[at == i])] == best


@pytest.mark.parametrize("dims, kind", [(3, "float"), (3, "double"), (40, "float")])
def test_top_k_over_many_blocks_and_groups(spark, monkeypatch, dims, kind):
    for name, value in (("CANDIDATES", 16), ("QUERIES", 8), ("GROUP", 64 * dims)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(dims)
    vectors = [(int(i), np.float32(rng.normal(0, 1, dims)).tolist()) for i in rng.permutation(700)]
    vectors += [(1000 + i, vectors[i % 3][1]) for i in range(200)]  # large groups of equal vectors
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")
    asked = df.where("vec_id % 7 = 0")
    out = topk.top_k(df, asked, 5)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect())
    assert got == brute_top(vectors, [v for v in vectors if v[0] % 7 == 0], 5)


def test_top_k_copies_no_query_block_for_each_candidate_block(spark, monkeypatch):
    """Packed queries go to groups of blocks, row by row from Python: an explode
    holds all copies of a row in memory, and a join on blocks makes one for each."""
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    df = spark.range(4000).selectExpr("id as vec_id", "array(cast(id % 97 as float), cast(id % 89 as float)) as embedding")
    plan = topk.top_k(df, df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "CartesianProduct" not in plan
    # All vectors ask, so each query block goes to the one group that memory needs.
    seen = []
    frame, deal = type(df), type(df).repartition

    def watched(self, n, *columns):
        seen.append(self.where("tree is not null").count())
        return deal(self, n, *columns)

    monkeypatch.setattr(frame, "repartition", watched)
    topk.top_k(df, df, 5)
    assert seen == [4]


def test_top_k_of_vectors_beyond_floats(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (rng.normal(0, 1, 3) * 10.0 ** rng.integers(0, 200)).tolist()) for i in range(60)]
    vectors += [(60 + i, [1e200, -1e200, 1e200]) for i in range(4)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors}
    got = {}
    for r in topk.top_k(df, df, 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id, r.score
    for q in ints:
        exact = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:4]
        assert {s for _, s in got[q].values()} == {max(-2 ** 63, min(2 ** 63 - 1, -s)) for s, _ in exact}


def test_search_goes_on_from_what_other_blocks_gave():
    rng = np.random.default_rng(6)
    points, ids = np.floor(256 * rng.normal(0, 1, (3000, 5))), rng.permutation(3000)
    queries = topk.cover_tree(ids[:300], points[:300])
    best = topk.Best(queries, 5)
    for start in range(0, 3000, 1000):
        at, who, score = topk.search(queries, topk.cover_tree(ids[start:start + 1000], points[start:start + 1000]), 5, best)
    want = points[:300] @ points.T
    for i in range(300):
        best = sorted((-s, j) for s, j in zip(want[i], ids) if j != ids[i])[:5]
        assert [(-s, j) for s, j in zip(score[at == i], who[at == i])] == best


# ------------------------------------------------------------------ 3
@pytest.mark.parametrize("name", ["documents", "odd"])
def test_token_counts(name, request):
    from tokenizers import Tokenizer
    tokenizer, df = Tokenizer.from_file(BPE), request.getfixturevalue(name)
    out = tokens.count_tokens(df, BPE)
    check_columns(out, df)
    got = sorted((r.n_bytes, r.n_tokens) for r in out.collect())
    assert got == sorted((len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False))) for r in rows(df))


# ------------------------------------------------------------------ 4
@pytest.mark.parametrize("name", ["documents", "odd"])
def test_pieces(name, request):
    import sentencepiece
    model, df = sentencepiece.SentencePieceProcessor(model_file=PIECES), request.getfixturevalue(name)
    out = sentencepiece_fst.encode(df, PIECES)
    check_columns(out, df)
    got = out.select("row.doc_id", "row.text", "ids", "round_trip").collect()
    for r in got:
        assert r.ids == model.encode(r.text or "") and r.round_trip
    back = sentencepiece_fst.decode(out.select("row.text", "ids").withColumnRenamed("text", "before"), PIECES)
    for r in back.select("row.before", "text").collect():
        assert r.text == (r.before or "").replace("▁", " ")


def test_pieces_keep_a_bounded_number_of_words():
    """Words met once are forgotten; one met again and again is not, and ids never change."""
    import sentencepiece
    model, fst = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_fst.Transducer(PIECES)
    kept = [fst.paths, fst.spaced, fst.atoms, fst.stays]
    for x in kept:
        x.most = 200
    made, often = [], fst.spaced.made
    fst.spaced.made = lambda word: made.append(word) or often(word)
    for k in range(40):
        text = " ".join(["again", *(f"w{k}x{i}\u00e9" for i in range(50)), "again"])
        assert fst.encode(text).tolist() == model.encode(text)
        assert all(len(x) <= x.most and len(x.before) <= x.most for x in kept)
    assert made.count("again") == 1 and len(made) > 1500
    assert 2 * max(sentencepiece_fst.WORDS, sentencepiece_fst.STRETCHES, sentencepiece_fst.PAIRS) <= 1 << 19


# ------------------------------------------------------------------ 5
def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = rng.integers(0, rng.choice([1, 2, 4, 255]) + 1, rng.integers(0, 80)).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_array.suffix_array(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        common = suffix_array.permuted_common_prefixes(text, order, 20)
        for x, y in zip(order[:-1], order[1:]):
            n = next((k for k in range(20) if raw[x + k:x + k + 1] != raw[y + k:y + k + 1] or y + k >= len(raw) or x + k >= len(raw)), 20)
            assert common[y] == n


def brute_cut(docs, length=100):
    seen, out = set(), []
    for _, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(b[i:i + length])
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_cut_repeats(documents):
    docs = sorted((r.doc_id, r.text) for r in rows(documents))
    out = {r.doc_id: bytes(r.kept) for r in suffix_dedup.cut_repeats(documents).select("row.doc_id", "kept").collect()}
    assert [out[i] for i, _ in docs] == brute_cut(docs)


def test_cut_repeats_with_every_anchor_hot(spark, monkeypatch):
    """Hot anchors go through the comparison by window, with the same result."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    docs = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 150))) + passage + "".join(rng.choice("xyz ") for _ in range(150)))
            for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: bytes(r.kept) for r in suffix_dedup.cut_repeats(df).select("row.doc_id", "kept").collect()}
    assert [out[i] for i, _ in docs] == brute_cut(docs)


def test_cut_repeats_odd(odd, empty):
    out = suffix_dedup.cut_repeats(odd)
    check_columns(out, odd)
    got = [(r.doc_id, r.text, bytes(r["out"])) for r in out.select("row.doc_id", "row.text", F.col("kept").alias("out")).collect()]
    assert len(got) == odd.count()
    # rows that share id and text are one document; null ids come last
    distinct = sorted({(r.doc_id, r.text) for r in rows(odd)}, key=lambda x: (x[0] is None, x[0] or 0))
    twins = [x for x in distinct if x[0] == 2]
    want = dict(zip(distinct, brute_cut(distinct), strict=True))
    assert len(twins) == 2 and all(want[(i, t)] == k for i, t, k in got)
    assert suffix_dedup.cut_repeats(empty).count() == 0


# ------------------------------------------------------------------ 6
def test_toxicity():
    rng = random.Random(6)
    plain = ["the", "river", "stone", "walks", "under", "bright", "morning", "windows", "carry", "letters"]
    slurs = ["scoundrel", "nitwit", "vermin"]
    def text(bad):
        words = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(30, 90))]
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(slurs))
        return " ".join(words).encode()
    labels = [i % 5 == 0 for i in range(600)]
    model = toxicity.train([text(y) for y in labels], [int(y) for y in labels])
    held = [(text(y), y) for y in labels]
    found = [(model.score(t) >= 0.3, y) for t, y in held]
    assert sum(p and y for p, y in found) >= 0.9 * sum(labels)
    assert sum(p and not y for p, y in found) <= 0.02 * len(labels)
    assert 0 <= model.score(b"") <= 1


def test_toxicity_of_a_small_language():
    rng = random.Random(7)
    tongues = [(["the", "river", "stone", "walks", "under", "bright", "morning"], ["scoundrel", "nitwit", "vermin"]),
               (["fluss", "unter", "steine", "morgen", "fenster", "briefe"], ["halunke", "dummkopf", "gesindel"])]
    def text(small, bad):
        plain, slurs = tongues[small]
        words = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(60)]
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(slurs))
        return " ".join(words).encode()
    of = [(i % 16 == 0, i % 5 == 0) for i in range(2400)]
    model = toxicity.train([text(*x) for x in of], [int(bad) for _, bad in of])
    for bad in (True, False):
        flagged = sum(model.score(text(True, bad)) >= toxicity.LIMIT for _ in range(100))
        assert flagged >= 90 if bad else flagged <= 2


def test_toxicity_deep_in_long_texts(spark):
    rng = random.Random(8)
    plain = ["the", "river", "stone", "walks", "under", "bright", "morning", "windows", "carry", "letters"]
    def text(bad):  # insults only after some 6000 clean characters
        words = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(1600)]
        return " ".join(words[:1000] + [w for x in words[1000:] for w in ([rng.choice(["scoundrel", "nitwit", "vermin"]), x] if bad and rng.random() < 0.1 else [x])])
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.where("doc_id < 120").drop("toxic"), docs.select("doc_id", "toxic"))
    got = [(model.score(t.encode()) >= toxicity.LIMIT, y) for i, t, y in rows if i >= 120]
    assert sum(p and y for p, y in got) >= 9 and not any(p and not y for p, y in got)
    assert len(toxicity.drawn(rows[0][1].encode())) <= toxicity.BYTES + 2


def test_toxicity_rows(odd, empty):
    model = toxicity.train([b"good words here"] * 9 + [b"bad nitwit words"] * 9, [0] * 9 + [1] * 9)
    for m in (model, None):
        out = toxicity.score_texts(odd, m)
        check_columns(out, odd)
        assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.fit(empty, empty.selectExpr("doc_id", "1 as toxic")) is None
    assert toxicity.fit(odd, odd.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")) is not None


# ------------------------------------------------------------------ 7
def fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = list(range(len(prints)))
    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_near_duplicates(name, request):
    df = request.getfixturevalue(name)
    out = simhash.near_duplicates(df)
    check_columns(out, df)
    got = out.select("row.doc_id", "row.text", F.col("fp").alias("print"), "component_id").collect()
    docs = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    prints = [fingerprint(r.text) for r in docs]
    assert [r.print % 2 ** 64 for r in docs] == prints
    group = brute_components(prints)
    least = {}
    for r, g in zip(docs, group, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert [r.component_id for r in docs] == [least.get(g) for g in group]


def test_links_in_a_dense_cluster(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(64)}
    while len(prints) < 800:  # random walks of few bits around one fingerprint
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [x - (x >> 63 << 64) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df)
    assert all(bin((r.u ^ r.v) % 2 ** 64).count("1") <= 64 for r in edges.collect())
    got = {r.node: r.label for r in components.components(edges).collect()}
    mine, want = [got.get(x, x) for x in signed], brute_components(prints)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ 8
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:n], rest[n:]
    m = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:m]


def longest_rule(host, path):
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def test_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    more = [(90001, None), (90002, ""), (90003, "no scheme/x"), (90004, "HTTP://A.Example.NET"), (90005, "x://net/://?q#f"),
            (90006, "https://ÄB.org/fr/ä?x"), (90007, "http://notnet/en/"), (90004, "HTTP://A.Example.NET"), (None, "http://h.example.com/de/1/2/3/4/5/6/7")]
    more += [(91000 + i, f"http://shop.example.com/item{chr(97 + i % 26)}{chr(97 + i // 26)}/page") for i in range(60)]
    df = pages.union(spark.createDataFrame(more, "page_id long, url string")).selectExpr("*", "'mine' as host", "1 as rule")
    out = urls.filter_urls(df, RULES)
    assert out.select("row.*").columns == df.columns
    got = out.select("row.url", F.col("host").alias("h"), "path", F.col("rule").alias("r"), "template", "purity", "verdict").collect()
    assert len(got) == df.count()
    for r in got:
        host, path = split_url(r.url)
        rule = longest_rule(host, path)
        assert (r.h, r.path, r.r) == (host, path, rule)
        assert r.verdict == (RULES[rule] if rule else "block" if r.purity > urls.LIMIT else "allow")
    wide = {tuple(r.template) for r in got if r.h == "shop.example.com"}
    assert wide == {("*", "page")}  # sixty rare segments are one wildcard
    assert urls.filter_urls(df.limit(0), RULES).count() == 0


def test_templates_merge_alike_branches_and_learn(spark):
    def shape(parts, n, blocked, labelled):
        return ("h", parts, n, blocked, labelled)
    df = spark.createDataFrame([shape(["a", "*"], 40, 39, 40), shape(["b", "*"], 30, 0, 30), shape(["c", "*"], 9, 0, 0)],
                               "host string, shape array<string>, n long, blocked long, labelled long")
    got = {r.shape[0]: r.purity for r in urls.templates(df).collect()}
    assert got["a"] > 0.5 > got["b"] and got["c"] == pytest.approx(urls.PRIOR)


def test_templates_without_labels_draw_on_their_siblings(spark):
    rows = [("h", ["a", "*"], 12, 12), ("h", ["b", "*"], 8, 8), ("h", ["c", "*"], 0, 0),  # all blocked: so is c
            ("g", ["a", "*"], 0, 12), ("g", ["c", "*"], 0, 0),
            ("k", ["a", "x"], 60, 60), ("k", ["a", "y"], 2, 2), ("k", ["a", "z"], 0, 0),  # one prefix
            ("k", ["b", "x"], 0, 90), ("k", ["b", "z"], 0, 0), ("k", ["d"], 0, 0),
            ("m", ["a"], 20, 20), ("m", ["b"], 18, 20), ("m", ["d"], 1, 20), ("m", ["e"], 0, 1), ("n", ["a"], 0, 0)]
    df = spark.createDataFrame([(h, s, 30, b, n) for h, s, b, n in rows],
                               "host string, shape array<string>, n long, blocked long, labelled long")
    got = {(r.host, *r.shape): r.purity for r in urls.templates(df).collect()}
    blocked = {k for k, p in got.items() if p > urls.LIMIT}
    assert blocked == {("h", "a", "*"), ("h", "b", "*"), ("h", "c", "*"), ("k", "a", "x"), ("k", "a", "y"), ("k", "a", "z"), ("m", "a"), ("m", "b")}
    assert got["k", "d"] == pytest.approx(urls.PRIOR) == got["n", "a"]
    # 20 and 18 of 20 are one group, 1 of 20 and 0 of 1 another.
    assert got["m", "a"] == pytest.approx(got["m", "b"]) and got["m", "d"] == pytest.approx(got["m", "e"])


def brute_tree(rows):
    """Purity by (host, shape) of rows (host, shape, n, blocked, labelled, since), node by node."""
    out = {}
    for host in {r[0] for r in rows}:
        mine = [(list(r[1]), [], *r[2:]) for r in rows if r[0] == host]
        for level in range(urls.DEPTH + 1):
            kids = {}
            for shape, template, n, *_ in mine:
                if len(shape) > level:
                    own = kids.setdefault(tuple(template), {})
                    own[shape[level]] = own.get(shape[level], 0) + n
            wide = {t for t, own in kids.items() if len(own) > urls.MANY and sum(own.values()) < urls.SEEN * len(own)}
            for shape, template, *_ in mine:
                if len(shape) > level:
                    template.append("*" if tuple(template) in wide and shape[level] else shape[level])
        x, n = {}, {}
        for _, template, _, blocked, labelled, since in mine:
            path = (*template, urls.END)
            for k in range(len(path) + 1):
                x[path[:k]] = x.get(path[:k], 0) + (blocked if k >= since else 0)
                n[path[:k]] = n.get(path[:k], 0) + (labelled if k >= since else 0)
        pooled, split = {}, {}
        for parent in n:
            kids = [k for k in n if k and k[:-1] == parent and n[k]]
            rates = sorted({x[k] / n[k] for k in kids})
            sums = [(sum(x[k] for k in kids if x[k] / n[k] == r), sum(n[k] for k in kids if x[k] / n[k] == r)) for r in rates]
            groups = []
            for i, (r, (a, b)) in enumerate(zip(rates, sums)):
                if i:
                    c, d = sums[i - 1]
                    q = (a + c) / (b + d)
                    var = q * (1 - q) * (1 / b + 1 / d)
                    alike = (a / b - c / d) ** 2 / var < urls.DIFFER if var else a * d == c * b
                if i and alike:
                    groups[-1].append(i)
                else:
                    groups.append([i])
            split[parent] = len(groups) > 1
            for g in groups:
                whole = tuple(sum(sums[i][j] for i in g) for j in (0, 1))
                pooled.update({k: whole for k in kids if x[k] / n[k] in [rates[i] for i in g]})
        for shape, template, *_ in mine:
            path, own, lent, told = (*template, urls.END), urls.PRIOR, urls.PRIOR, -1
            for k in range(len(path) + 1):
                node = path[:k]
                a, b = pooled.get(node, (x[node], n[node]))
                if not (n[node] > 0 and n[node] == told):
                    own = (a + urls.STRENGTH * lent) / (b + urls.STRENGTH)
                lent, told = lent if split[node] else own, n[node]
            out[host, tuple(shape)] = own
    return out


def test_tree_against_brute_force(spark):
    rng = random.Random(10)
    rows_ = {}
    for _ in range(500):
        host = rng.choice("abc")
        shape = tuple(rng.choice(["x", "y", "z", "", f"w{rng.randint(0, 40)}"] if d == 1 else ["p", "q", "*"]) for d in range(rng.randint(0, 4)))
        n = rng.randint(1, 9)
        labelled = rng.choice([0, 0, n])
        blocked = sum(rng.random() < (0.9 if "x" in shape else 0.1) for _ in range(labelled))
        rows_[host, shape, rng.choice([0, 0, 1, 2])] = (n, blocked, labelled)
    listed = [(h, list(s), *v, since) for (h, s, since), v in rows_.items()]
    df = spark.createDataFrame(listed, "host string, shape array<string>, n long, blocked long, labelled long, since int")
    got = {(r.host, tuple(r.shape)): r.purity for r in urls.templates(df).collect()}
    assert got == pytest.approx(brute_tree(listed))


def test_a_path_rule_says_nothing_of_other_paths(spark):
    """A host with mostly German pages, which a rule blocks, keeps its English ones; below the
    rule's path its labels are lent."""
    seen = [f"http://a.example.com/de/{k}" for k in range(60)] + [f"http://a.example.com/en/{k}" for k in range(5)] + ["http://a.example.com/"]
    seen += [f"http://b.example.net/shop/{k}" for k in range(9)]
    long = "http://a.example.com/en/" + "x/" * 50_000
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*seen, long])], "page_id long, url string")
    got = {r.url: r.verdict for r in urls.filter_urls(df, RULES).select("row.url", "verdict").collect()}
    assert {u for u, v in got.items() if v == "block"} == {u for u in seen if "/de/" in u or "example.net" in u}


# ------------------------------------------------------------------ 9
def test_language():
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").dropna()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.doc_id])
    seen, rest = docs[~held].head(1500), docs[held].head(500)
    net, names = langid.train([t.encode() for t in seen.text], seen.lang.tolist())
    told = langid._of_texts([t.encode() for t in rest.text], net, names)
    assert np.mean([k == y for (k, _), y in zip(told, rest.lang, strict=True)]) > 0.97
    x = langid.windows(rest.text.iloc[0].encode())  # the fast form is the network
    slow = langid._softmax(np.maximum(net.pooled(x)[0], 0) @ net.out + net.bias)
    assert np.allclose(slow, net.probabilities(x), atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(0)
    net, x, y = langid.Network(3), rng.integers(0, 256, (4, 40)).astype(np.int16), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(langid._softmax(np.maximum(net.pooled(x)[0], 0) @ net.out + net.bias)[np.arange(4), y]).mean()
    grads = net.gradients(x, y)
    for w, g in zip(net.weights(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, w[i] = w[i], w[i] + 1e-3
        up = loss()
        w[i] = before
        assert up - loss() == pytest.approx(1e-3 * g[i], rel=0.2, abs=1e-5)


def test_language_rows(odd, empty):
    model = langid.fit(odd)
    out = langid.identify(odd, model)
    check_columns(out, odd)
    got = out.select("row.text", "lang_pred", F.col("score").alias("p")).collect()
    assert all(0 <= r.p <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert langid.fit(empty) is None and langid.identify(empty, None).count() == 0


def test_copies_do_not_push_out_a_language(spark):
    """2000 German and 2000 English texts, and 5000 copies of one Spanish text."""
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")
    rows_ = [(t, y) for y in ("de", "en") for t in docs[docs.lang == y].text.head(300)]
    spanish = docs[docs.lang == "es"].text.iloc[0]
    df = spark.createDataFrame(rows_, "text string, lang string").union(
        spark.createDataFrame([(spanish, "es")], "text string, lang string").crossJoin(spark.range(5000)).drop("id"))
    net, names = langid.fit(df)
    assert names == ["de", "en", "es"]
    assert langid._of_texts([spanish.encode()], net, names)[0][0] == "es"


def test_many_languages(spark):
    """Every one of 150 languages is learnt, the wording of half of them only deep in the texts."""
    rng = random.Random(9)
    filler = "0123456789 " * 400
    def text(k):
        a, b = divmod(k, 13)
        words = " ".join(chr(97 + a) + chr(97 + b) * rng.randint(1, 3) + rng.choice("xyz") for _ in range(60))
        return (filler if k % 2 else "") + words * (20 if k % 2 else 1)
    df = spark.createDataFrame([(text(k), f"l{k:03}") for k in range(150) for _ in range(6)], "text string, lang string")
    net, names = langid.fit(df)
    assert len(names) == 150
    told = langid._of_texts([text(k).encode() for k in range(150)], net, names)
    assert sum(y == f"l{k:03}" for k, (y, _) in enumerate(told)) >= 120
    assert len(langid.drawn(text(1).encode())) <= langid.DRAWN


# ------------------------------------------------------------------ 10
@pytest.mark.parametrize("name", ["documents", "odd"])
def test_mixing(name, request):
    df = request.getfixturevalue(name)
    out = mixing.mix(df)
    check_columns(out, df)
    got = out.select("row.doc_id", "row.text", "row.source", F.col("size").alias("n"), "source_size",
                     F.col("target").alias("goal"), "taken", "position").collect()
    size = {}
    for r in got:
        assert r.n == len([w for w in __import__("re").split("[\x20\x09-\x0d]+", r.text or "") if w])
        size[r.source] = size.get(r.source, 0) + r.n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, stopped = sum(size.values()), set()
    while True:  # the excess is reshared until no source is above
        level = (total - sum(3 * size[s] for s in stopped)) / max(1, sum(weight[s] for s in order if s not in stopped))
        over = {s for s in order if s not in stopped and weight[s] * level > 3 * size[s]}
        if not over:
            break
        stopped |= over
    for s in order:
        mine = [r for r in got if r.source == s]
        goal = 3 * size[s] if s in stopped else weight[s] * level
        assert all(r.goal == pytest.approx(goal) and r.source_size == size[s] and r.taken <= 3 * r.n for r in mine)
        assert abs(sum(r.taken for r in mine) - goal) <= 1
    assert all((r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1) for r in got)
    again = mixing.mix(df.repartition(3)).select("row.doc_id", F.col("size").alias("n"), "taken").collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n, r.taken)
    assert sorted(map(key, again)) == sorted(key(r) for r in got)


def test_copies_follow_the_ramps(spark):
    # One source of each weight class: the small ones are repeated beside the large ones.
    sources = {"a": 1500, "b": 60, "c": 90, "d": 1200, "e": 300, "f": 200}
    docs = spark.createDataFrame([(f"{s}{i}", s, "w " * (1 + i % 7)) for s, n in sources.items() for i in range(n)],
                                 "doc_id string, source string, text string")
    taken = {(r.doc_id): r.taken for r in mixing.mix(docs).select("row.doc_id", "taken").collect()}
    got = mixing.mix_copies(docs).select("row.doc_id", "row.source", "size", "pass", "words", "position").collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    of = {}
    for r in got:
        of[r.doc_id] = of.get(r.doc_id, 0) + r.words
    assert of == {i: n for i, n in taken.items() if n}
    assert max(r["pass"] for r in got) == 2
    for rank, s in enumerate(sorted(sources)):
        a, b = mixing.RAMPS[rank % 3]
        whole = sum(r.words for r in got if r.source == s)
        for t in (0.1, 0.25, 0.5, 0.75, 0.9):
            due = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            assert sum(r.words for r in got if r.source == s and r.position <= t) / whole == pytest.approx(due, abs=8 / whole)


def test_mixing_nothing(empty):
    assert mixing.mix(empty).count() == 0


def test_empty_tables(empty):
    assert quality.judge(empty).count() == tokens.count_tokens(empty, BPE).count() == 0
    assert sentencepiece_fst.encode(empty, PIECES).count() == simhash.near_duplicates(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest()
