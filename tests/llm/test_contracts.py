"""The columns of the thin queries against brute force, over whole test tables."""

import hashlib
import zlib

import pandas as pd
import public_tokenizers
import pytest
from corpus_paths import SF
from test_operators import RULES, brute_components, brute_cut, fingerprint, longest_rule, split_url

from ledgerlens.llm import queries, toxicity


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


def result(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


def test_tokens(spark, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = result(spark, "op3_tokens").sort_values("doc_id")
    texts = [t or "" for t in docs.text]
    many = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    assert got.n_bytes.tolist() == [len(t.encode()) for t in texts] and got.n_tokens.tolist() == many
    assert got.over_limit.tolist() == [n > 512 for n in many]


def test_suffix_dedup(spark, docs):
    rows = list(docs[["doc_id", "text"]].itertuples(index=False))
    got = result(spark, "op5_suffix_dedup").sort_values("doc_id")
    kept = brute_cut(rows)
    assert got.n_bytes.tolist() == [len((t or "").encode()) for _, t in rows]
    assert got.n_removed.tolist() == [len((t or "").encode()) - len(k) for (_, t), k in zip(rows, kept, strict=True)]
    assert got.kept_sha256.tolist() == [hashlib.sha256(k).hexdigest() for k in kept]
    seen, spans = set(), []
    for _, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(b[i:i + 100])
        spans.append(len([x for x in bytes(gone).split(b"\0") if x]))
    assert got.n_spans.tolist() == spans


def test_simhash(spark, docs):
    got = result(spark, "op7_simhash").sort_values("doc_id")
    prints = [fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    group, ids = brute_components(prints), docs.doc_id.tolist()
    least = {}
    for i, g in zip(ids, group, strict=True):
        least[g] = min(least.get(g, i), i)
    assert got.component_id.tolist() == [least[g] for g in group]


def test_urls(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").url
    got = result(spark, "op8_urls")
    assert sorted(got.page_id) == sorted(pages.index)
    for r in got.itertuples():
        host, path = split_url(pages[r.page_id])
        rule = longest_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == RULES[rule] if rule else r.verdict in ("allow", "block")


@pytest.mark.parametrize("name, folds, rest", [("op6_toxicity", 4, 2), ("op9_language", 5, 0)])
def test_held_out(spark, docs, name, folds, rest):
    got = result(spark, name)
    assert sorted(got.doc_id) == docs.doc_id.tolist() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == rest for i in got.doc_id]).all()
    if name == "op6_toxicity":
        assert (got.predicted == (got.score >= toxicity.LIMIT)).all()
    else:
        text = docs.set_index("doc_id").text
        for r in got.itertuples():
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))
        held = got[got.held_out & (got.lang_pred != "und")].merge(docs, on="doc_id")
        assert (held.lang_pred == held.lang).mean() > 0.9
