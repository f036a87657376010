from __future__ import annotations

import random

import pytest

#: Names that the operators use inside, as columns of their input.
CLASHING = ("id", "ref", "n", "size", "h", "bucket", "key", "comp", "kept", "keep_id", "a", "b", "kind", "data", "score", "predicted", "target", "taken", "skey", "cell", "slot", "shard", "label", "host", "day", "line", "uid", "text_sha256")


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls, empty and blank texts, one very long, ties, repeated rows, near copies."""
    rng = random.Random(7)
    rows = [(1, None, "en", "s1"), (2, "", None, "s1"), (3, " \t\n", "en", None), (4, "one", "en", "s2"), (5, "One two", "en", "s2"), (6, "one  two", "fr", "s2"), (None, "lost words here", "en", "s1"), (None, None, None, None)]
    rows += [(7, "same text", "en", "s1"), (7, "same text", "en", "s1"), (8, "same text", "de", "s3")]
    rows.append((9, " ".join(words(rng, 60_000, 50_000)), "en", "s3"))
    rows.append((10, "é" * 30_000 + "\n" + "x" * 30_000, "fr", "s3"))
    for k in range(12):
        base = words(rng, rng.randrange(4, 150))
        for j in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            rows.append((20 + 10 * k + j, (" " if j % 2 else "\n").join(copy), rng.choice(["en", "de", "fr"]), rng.choice(["s1", "s2", "s3", "s4"])))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in CLASHING:
        df = df.withColumn(name, F.lit(f"clash-{name}"))
    return df.repartition(5)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
