"""Embeddings against brute force, URLs against SQL and by example, the pipeline stage by stage."""

from __future__ import annotations

import math
import os
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import embedding_dedup, mixing, registry, toxicity, url_filter

from .test_dedup import joined, near_brute, normal

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def vectors_brute(rows):
    unit = []
    for i, v, label in rows:
        ok = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None, label))
    links = [(a, b) for a, (_, x, l) in enumerate(unit) for b, (_, y, m) in enumerate(unit[:a]) if x is not None and y is not None and l == m and len(x) == len(y) and x @ y >= 0.98]
    home, n = joined(links, range(len(rows))), Counter(k for e in links for k in e)
    name = {}
    for k, (i, *_) in enumerate(rows):
        name[home[k]] = min(name.get(home[k], i), i)
    return Counter((i, n[k], name[home[k]], i == name[home[k]]) for k, (i, *_) in enumerate(rows))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [1.0] * 16, None), (907, [1.0] * 16, 1), (908, [2.0] * 16, 1), (909, [1.0] * 8, 1), (910, [3.0] * 16, 2), (911, [1e-30] * 16, 1)]
    for c in range(25):
        base = rng.normal(size=16)
        for k in range(int(rng.integers(1, 9))):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.uniform(0, 0.25)], int(c % 3)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit("clash")).withColumn("keys", F.lit(0))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = Counter(tuple(r) for r in embedding_dedup.near_vectors(df).collect())
    want = vectors_brute(as_float)
    assert sum((got & want).values()) >= 0.97 * len(rows)
    assert all(r[1] <= max(w[1] for w in want if w[0] == r[0]) for r in got)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_no_vector_is_left_out(spark):
    """Many lengths, and values whose squares are no finite or normal number; equal vectors, also of one vec_id."""
    rng = np.random.default_rng(8)
    rows = [(2 * d + k, [float(x) for x in v], 1) for d in range(1, 81) for v in [rng.normal(size=d)] for k in (0, 1)]
    rows += [(k, v, 2) for k, v in enumerate(([1e-200, 2e-200], [1e-200, 2e-200], [1e200, 2e200], [5e-324, 1e-323], [-1e200, 0.0], [-1e200, -0.0]), 1000)]
    df = spark.createDataFrame([*rows, rows[0], (2, [9.0], 1), (None, [1.0] * 3, 3), (None, [1.0] * 3, 3), (7000, [0.0], 5), (7001, [0.0], 5), (7001, [None], 5)], "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.near_vectors(df).collect()
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in out)
    want = Counter((2 * d + k, 1, 2 * d) for d in range(2, 81) for k in (0, 1))
    one = [v for _, v, _ in rows[:2]] + [[9.0]]
    for i, v in zip((2, 3, 2), one, strict=True):
        near = sum(x[0] * v[0] > 0 for x in one) - 1
        want[i, near, 2 if near or i == 2 else 3] += 1
    want += Counter([(1000, 3, 1000), (1001, 3, 1000), (1002, 3, 1000), (1003, 3, 1000), (1004, 1, 1004), (1005, 1, 1004), (None, 0, None), (7000, 0, 7000), (7001, 0, 7001), (7001, 0, 7001)])
    assert got == want


def test_copies_are_one_class(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    rows = [(k, [float(x) for x in base], 0) for k in range(60)] + [(100 + k, [float(x) for x in base + rng.normal(size=24) * 0.02], 0) for k in range(5) for _ in range(3)]
    rows += [(200 + k, rows[-1][1], 0) for k in range(7)]
    got = Counter(tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == vectors_brute([r for k, r in enumerate(rows) if r not in rows[:k]])


def test_pivots_go_with_the_rows():
    assert [embedding_dedup.pivot_count(n) for n in (0, 10**4, 10**5, 10**9)] == [128, 128, 512, 8192]
    made = embedding_dedup.Pivots({3: np.eye(3)}, 8)
    assert made[3].shape == (8, 3) and made[5].shape == (8, 5) and (made[3] == embedding_dedup.Pivots({3: np.eye(3)}, 8)[3]).all()


def alike(rng, n, d, cosine):
    """Unit vectors of a mean cosine."""
    mean = rng.normal(size=d)
    x = mean / np.linalg.norm(mean) * np.sqrt(cosine) + rng.normal(size=(n, d)) * np.sqrt((1 - cosine) / d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("d", "cosine", "n", "most"), [(64, 0, 16_000, 0.05), (64, 0.7, 16_000, 0.05), (64, 0.9, 16_000, 0.06), (256, 0.9, 16_000, 0.05), (2, 0, 3000, 0.5), (3, 0, 3000, 0.15), (4, 0, 3000, 0.1), (8, 0, 3000, 0.05), (768, 0, 3000, 0.05)])
def test_settings_follow_the_vectors(spark, d, cosine, n, most):
    """In a cone and in few dimensions too, lists hold few of all pairs (in 2 dimensions, many pairs are links) and the hardest links are found."""
    rng = np.random.default_rng(d)
    x = alike(rng, n, d, cosine)
    rows = [(b"%06d" % k, v.tobytes(), "0") for k, v in enumerate(x[:5000])]  # the sample is of the first by a hash
    pivots = embedding_dedup.fit_pivots(spark.createDataFrame(rows, "cls binary, unit binary, label string"), n)
    near = np.sort(embedding_dedup._nearest(x, pivots[d], pivots.nearest), axis=1)
    picks = near[:, np.array(list(combinations(range(pivots.nearest), pivots.shared)))]
    sizes = np.unique((picks * pivots.count ** np.arange(pivots.shared)).sum(2), return_counts=True)[1].astype(float)
    assert (sizes * (sizes - 1) / 2).sum() < most * n * n / 2
    some = x[-1000:]
    held = [embedding_dedup._held(embedding_dedup._nearest(v, pivots[d], pivots.nearest), len(pivots[d])) for v in (some, embedding_dedup.hardest(some, 0.98, 99))]
    assert ((held[0] * held[1]).sum(1) >= pivots.shared).mean() >= 0.93


@pytest.mark.parametrize(("d", "cosine"), [(2, 0), (3, 0), (4, 0), (8, 0), (48, 0.9)])
def test_recall_of_links(spark, d, cosine):
    """Links of the whole operator against brute force, over random vectors with a near one each."""
    rng = np.random.default_rng(40 + d)
    x = alike(rng, 350, d, cosine)
    x = np.vstack([x, embedding_dedup.hardest(x, 0.985, 1)])
    rows = [(k, v.tolist(), k % 2 if d < 48 else 0) for k, v in enumerate(x)]
    rows = [(i, v, rows[i % 350][2]) for i, v, _ in rows]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    labels = np.array([r[2] for r in rows])
    links = ((x @ x.T >= 0.98) & (labels[:, None] == labels)).sum(1) - 1
    assert all(got[k] <= links[k] for k in got) and sum(got.values()) >= 0.9 * links.sum() > 0


def test_a_large_family_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=32)
    rows = [(k, [float(x) for x in base + rng.normal(size=32) * 0.03], 0) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = embedding_dedup.near_vectors(df).collect()
    want = vectors_brute(rows)
    assert sum(r.n_links for r in out) >= 0.99 * sum(w[1] for w in want)
    assert {(r.vec_id, r.component_id) for r in out} == {(w[0], w[2]) for w in want}


ENTRIES = [
    (1, 10, "Bad.example", "block", "spam"), (2, 20, "bad.example", "drop", "spam"), (3, 30, "bad.example", "block", "adult"), (4, 10, "ok.bad.example", "allow", "none"), (5, 12, "x.example/ads", "block", "ads"),
    (6, 40, "same.day", "block", "a"), (7, 40, "same.day", "allow", "b"), (8, None, "never", "block", "c"), (9, 1, None, "block", "c"), (9, 1, "nothing", None, "c"),
    (10, 1, "[2001:db8::1]", "block", "c"), (11, 1, "0.0.1", "block", "c"), (12, 1, "9.0.0.1", "block", "c"), (13, 1, "0.0.1.example", "block", "c"), (14, 1, "[2001", "block", "c"), (15, 1, "[:", "block", "c"),
]
CAPTURES = [
    (1, "http://bad.example/", 9, None), (2, "http://bad.example/x", 10, "bad.example"), (3, "https://u@a.BAD.example.:80/x", 19, "bad.example"), (4, "http://bad.example", 20, None), (5, "http://bad.example", 30, "bad.example"),
    (6, "http://ok.bad.example", 35, "ok.bad.example"), (7, "http://x.example/ads/1", 12, "x.example/ads"), (8, "http://x.example/adsy", 12, None), (9, "http://same.day", 40, "same.day"), (10, None, 40, None), (11, "no url", 40, None), (12, "http://bad.example", None, None),
    (None, "http://bad.example", 10, "bad.example"), (2, "http://bad.example/x", 10, "bad.example"),
    (13, "http://[2001:DB8::1]:80/a", 10, "[2001:db8::1]"), (14, "http://[2001:db8::2]/a", 10, None), (15, "http://10.0.0.1/", 10, None), (16, "http://u@9.0.0.1:8/", 10, "9.0.0.1"), (17, "http://10.0.0.1.example/", 10, "0.0.1.example"), (18, "http://[::1", 10, None),
]


def test_urls_by_example(spark):
    entries = spark.createDataFrame(ENTRIES, "entry_id int, day int, pattern string, action string, category string")
    captures = spark.createDataFrame([c[:3] for c in CAPTURES], "id long, url string, day int").withColumn("since", F.lit(1)).withColumn("pattern", F.lit("clash"))
    out = url_filter.judge(captures, entries)
    assert Counter((r.id, r.rule) for r in out.collect()) == Counter((c[0], c[3]) for c in CAPTURES)
    assert {r.id for r in out.where("blocked").collect()} == {None, 2, 3, 5, 7, 13, 16, 17}
    assert out.where("id = 9").first().category == "b"
    assert url_filter.judge(captures.limit(0), entries).count() == 0
    assert url_filter.judge(captures, entries.limit(0)).where("rule is not null").count() == 0


def test_hosts_equal_sql(spark, tmp_path):
    """Addresses, userinfo, ports and nulls, by the query and by its SQL."""
    urls = ["http://10.0.0.1/a/b", "http://10.0.0.1:80/", "http://[2001:DB8::1]/a", "https://u:p@[::ffff:1.2.3.4]:8080/x", "http://10.0.0.1.example./q", "ftp://sub.a.example", None, "none", "http://[::1", "http:///x", "http://one/", "http://1.2.3/"]
    rows = [(k, urls[k % len(urls)], "") for k in range(20 * len(urls))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in url_filter.op9_url_filter(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(con.sql(registry.oracle_sql()["op9_url_filter"]).fetchall())
    hosts = {r[1] for r in got}
    assert {"10.0.0.1", "[2001:db8::1]", "[::ffff:1.2.3.4]", "10.0.0.1.example", "1.2.3", None} <= hosts and not any(r[4] in ("0.1", "0.0.1") for r in got)


@here
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"create view {table} as from '{SF}/{table}.parquet'")
    df, wanted = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(wanted.columns) == columns
    rows = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[c] for c in columns) for r in rows)


@here
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"op13_packing"}))  # a row a piece: test_packing
def test_one_row_each(spark, name):
    table = {"op4": "embeddings", "op9": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    assert registry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_stages(spark, edge_rows, edge_docs, tmp_path):
    """Every stage on the edge cases: what it keeps, its columns, and none of its columns clash."""
    marked = [(i, int(i // 10 % 4 == 2)) for i, *_ in edge_rows if i is not None and i >= 20]
    spark.createDataFrame([*marked, (None, 1), (4, None)], "doc_id long, toxic int").withColumn("quality", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge_docs.withColumn("text", F.when((F.col("doc_id") >= 20) & (F.floor(F.col("doc_id") / 10) % 4 == 2), F.concat("text", F.lit(" vile scum"))).otherwise(F.col("text")))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path, given = f"{tmp_path}/{k}", docs
        before = [(r.doc_id, r.text, None) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == edge_docs.columns
        after = Counter(r.doc_id for r in docs.collect())
        if name == "toxicity":
            model = toxicity.fit(given, spark.read.parquet(f"{tmp_path}/labels.parquet"), lambda i: toxicity.learned(i, 5))
            assert after == Counter(i for i, t, _ in before if toxicity.Scorer(model)(t or "") < 0.5) and 0 < after.total() < len(before)
        if name == "mixing":
            want = Counter()
            for r in mixing.mix(given).collect():
                want[r.doc_id] += r.copies
            assert after == +want
        if name == "exact dedup":
            assert sum(after.values()) == len({normal(t) for _, t, _ in before})
        if name == "near dedup":
            assert after == Counter(i for (i, _, c), n in near_brute(before).items() if i == c for _ in range(n))
        if name == "encoding":
            assert all(r.lossless for r in docs.collect()) and after == Counter(i for i, *_ in before)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "encoding"]


@here
def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "lossless"] and 0 < out.count() and out.where("not lossless").count() == 0

