import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from corpus_paths import SF  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows,
    and columns named like the operators' own."""
    passage = "one passage that some texts share word for word and that is well over a hundred bytes long, as it must be. "
    rows = [
        (1, passage + "first", "en", "a"), (2, "again " + passage + "second", "en", "a"), (2, "again " + passage + "second", "en", "a"),
        (3, None, "en", None), (4, "", None, "a"), (5, " \n\t ", "de", "b"), (None, passage + "first", "fr", "b"),
        (6, "x" * 50_000, "en", None), (7, "ab " * 20_000, "en", "c"), (8, "Ünï cödé 日本語 🙂 ▁ text\u00a0with\x00odd <|endoftext|> signs", "de", "c"),
        (9, "word", "en", "c"), (10, "line\nline\nline\n\nline", "es", "a"), (2, "another text of the same id", None, "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clashing = ("fp", "row", "size", "key", "body", "id", "tie", "kept", "target", "slice", "n_bytes", "score")
    return df.selectExpr("*", "cast(null as bigint) as n_chars", *[f"'mine' as {c}" for c in clashing])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
