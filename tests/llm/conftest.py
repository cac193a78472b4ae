import pytest
from pyspark.sql import Row

TEXTS = [
    None, "", "   \t\n", "Alpha beta gamma", "alphabeta gamma", "Alpha  beta\ngamma", "Alpha beta gamma", "é è Ü ß 漢字", "é è Ü ß 漢字 ",
    "word " * 3000, "word " * 3000, "x", "one two", "mail a.b@c.de now", "x" * 5000,
]
CLASHES = ("row", "run", "digest", "key", "slice", "shard", "fp", "rank", "base", "length", "w", "pos", "d", "doc", "tpl", "says", "_sl")


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empties, ties, repeated rows, a null id, long texts and columns with clashing names."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3]), (None, "Alpha beta gamma"), (None, None)]
    return spark.createDataFrame([Row(doc_id=i, text=t, **{c: k for k, c in enumerate(CLASHES)}) for i, t in rows],
                                 "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, list) else (True, "", str(v)) for v in r))
