"""Rows that every operator must stand: nulls, blanks, ties, repeats, long texts, extra columns."""

import random

import pytest

WORDS = "river stone light garden market window letter morning silver thunder copper valley harbour candle meadow winter forest bridge island shadow".split()


def make_documents(seed: int = 7, n: int = 120):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    texts += [None, "", "   ", "\n\t", "one two", "one two", "One  Two", " ".join(rng.choices(WORDS, k=30_000))]
    base = " ".join(rng.choices(WORDS, k=80))
    texts += [base] * 5 + [base + " " + w for w in WORDS[:6]] + [" ".join(base.split()[k:]) for k in (1, 2, 3, 30)]
    texts += ["mail a.b@example.com or 192.168.0.1, call +49 (30) 1234-5678, card 4111 1111 1111 1111 now", "no@match x@y 999.1.1.1 1.2.3.4.5 +12 4111 1111 1111 1112", "ünï 🙂 naïve@ex.org, 'tis don't stop 123456"]
    rows = [(k * 3, t, rng.choice(["en", "de", None]), "hot" if k % 3 else f"s{k % 5}", None if t is None else len(t), "row", 5) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, "without id", "en", "x", 10, "row", 5)]


DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, n int"


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as a table; row, n and further names clash with the operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(rows, DDL).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
