"""The stages one by one: each works on what its predecessor kept."""

import corpus_pipeline as P
import pytest
from corpus_paths import SF

from ledgerlens.llm import quality, queries
from ledgerlens.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, documents):
    out, docs = [documents], documents
    for _, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_stages(spark, documents, stages):
    _, good, single, cut, mixed, coded = stages
    assert all(s.columns == documents.columns for s in stages[:-1])
    texts = {r.doc_id: r.text for r in documents.collect()}
    failed = quality.cascade(quality.Measures([t.encode() for t in texts.values()]), quality.RULES)
    kept = {i for i, k in zip(texts, failed) if k < 0}
    assert {r.doc_id for r in good.collect()} == kept
    groups = {}
    found = P.simhash.near_duplicates(good, keep=["doc_id"]).select("row.doc_id", "component_id").collect()
    for r in found:
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups.values())
    after = {r.doc_id: r for r in cut.collect()}
    assert set(after) == {min(g) for g in groups.values()}
    assert all(len(r.text) == r.n_chars or r.text == texts[i] for i, r in after.items())
    assert {r.doc_id for r in mixed.collect()} <= set(after)
    assert coded.count() == mixed.count() and all(r.round_trip for r in coded.collect())


def test_run_is_the_stages(spark, stages):
    assert P.run(spark, SF).count() == stages[-1].count()


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in P.STAGES[:-1]:  # each stage alone copes with them
            assert stage(spark, docs, SF).columns == docs.columns
            assert stage(spark, docs, SF).count() <= 3 * docs.count()
    one = P.near_duplicates(spark, odd, SF).collect()
    assert len({(r.doc_id, r.text) for r in one}) == len(one)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()[list(mine.columns)]
    order = list(mine.columns)
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (mine, want.astype(mine.dtypes.to_dict())))
    assert a.equals(b)
