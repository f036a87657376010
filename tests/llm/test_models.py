"""Classifiers by held-out accuracy and edge cases; tokens by an independent encoder."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bpe, language_id, linear, toxicity

STEMS = {"en": ("the", "ing", "and", "tion"), "de": ("der", "ung", "und", "keit"), "fr": ("le", "eau", "et", "tion"), "es": ("el", "ción", "y", "mente")}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = [(k, sentence(rng, lang, rng.randrange(5, 60)), lang) for k, lang in enumerate(rng.choice(list(STEMS)) for _ in range(600))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))


def test_language_is_found_out(spark, spoken):
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    model = language_id.fit(spoken, ~held, per_language=60)
    out = language_id.identify(spoken, model, held.alias("held_out")).join(spoken.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert [p[0] for p in model.pairs] == ["", "germanic", "romance"]


def test_language_edge_cases(spark, spoken, edge_rows, edge_docs, no_docs):
    model = language_id.fit(spoken, F.lit(True), per_language=40)
    got = {(r.doc_id, r.lang_pred == "und") for r in language_id.identify(edge_docs, model).collect()}
    assert got == {(i, not any(c.isalpha() for c in t or "")) for i, t, *_ in edge_rows}
    assert language_id.identify(no_docs, model).count() == 0
    odd = spark.createDataFrame([(1, "½ ² 12 _!"), (2, "½a")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in language_id.identify(odd, model).collect()} == {1: True, 2: False}
    nothing = language_id.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(edge_docs, nothing).collect()} == {"und"}
    one = language_id.fit(spoken.where("lang = 'en'"), F.lit(True), per_language=5)
    assert {r.lang_pred for r in language_id.identify(spoken, one).collect()} == {"en"}


@pytest.mark.parametrize("ids", ["null", "one", "few", "unique"])
def test_every_language_is_sampled(spark, ids):
    """Null and repeated ids, and texts that repeat, leave each language its share, and the sample is the same in every run."""
    rng, rows = random.Random(9), []
    for lang in ("de", "en", "fr"):
        for k in range(900):
            doc_id = {"null": None, "one": 4, "few": k % 3, "unique": len(rows)}[ids]
            rows.append((doc_id, sentence(rng, lang, 12) if k % 3 else f"{lang} again", lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rows += [(None, "el y ción", "es")] * 50
    df = df.union(spark.createDataFrame(rows[-50:], df.schema))
    found = language_id.sample(df.repartition(3), F.lit(True), 100, 1 << 20)
    assert Counter(r.lang for r in found) == {"de": 100, "en": 100, "fr": 100, "es": 1}
    assert len({(r.doc_id, r.text) for r in found}) == 301
    assert [(r.doc_id, r.text) for r in language_id.sample(df.repartition(5), F.lit(True), 100, 1 << 20)] == [(r.doc_id, r.text) for r in found]
    assert set(language_id.fit(df, F.lit(True), per_language=60).families) == {"germanic", "romance"}


def test_a_language_without_family_is_its_own(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(w) for _ in range(20)), lang) for k, (lang, w) in enumerate([("xx", ("qq", "zz")), ("yy", ("mm", "nn")), ("en", ("the", "and"))] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    assert set(model.families) == {"germanic", "xx", "yy"}
    out = language_id.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang == r.lang_pred for r in out)


def test_scores_are_those_of_the_machines(spark, spoken, edge_rows, edge_docs):
    """Every machine on the counts of the whole text, one by one."""
    model = language_id.fit(spoken, F.lit(True), per_language=30)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.identify(edge_docs, model).collect())
    want = Counter()
    for i, text, *_ in edge_rows:
        x = np.zeros(language_id.DIM)
        for run in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            for n in (1, 2, 3):
                for k in range(len(run) + 3 - n):
                    x[zlib.crc32(f"^{run}$"[k : k + n].encode()) % language_id.DIM] += 1
        if not x.any():
            want[i, "und", 0.0] += 1
            continue
        margin = (x / x.sum() * model.scale) @ model.weights[:-1] + model.weights[-1]
        at, score = "", 1.0
        for _ in range(2):
            names = sorted(model.families) if at == "" else model.families[at]
            duels = {n: [m if n == a else -m for (w, a, b), m in zip(model.pairs, margin, strict=True) if w == at and n in (a, b)] for n in names}
            at = max(names, key=lambda n: (sum(d > 0 for d in duels[n]), sum(duels[n]), n))
            score *= min([1 / (1 + np.exp(-2 * np.clip(d, -15, 15))) for d in duels[at]], default=1.0)
        want[i, at, round(float(score), 9)] += 1
    assert got == want


def test_sixty_languages(spark):
    """Many languages without a family: few machines, and all are told apart. The sample does not hang on the partitions."""
    rng = random.Random(5)
    stock = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)] for k in range(60)}
    rows = [(len(stock) * k + j, " ".join("".join(rng.choice(w) for _ in range(rng.randrange(1, 4))) for _ in range(60)), lang) for k in range(8) for j, (lang, w) in enumerate(stock.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, again = (language_id.fit(df.repartition(n), F.col("doc_id") < 360, per_language=5) for n in (3, 7))
    assert model.key == again.key
    assert sorted(v for f in model.families.values() for v in f) == sorted(stock) and len(model.pairs) < 600
    out = language_id.identify(df.where("doc_id >= 360"), model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.9


BAD = ("scum", "idiot", "trashy", "moron")


def toxic_rows(n, seed, identity="women", share=0.8):
    """Toxic texts mostly name a group; clean ones rarely do."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.4
        w = [f"n{rng.randrange(300)}" for _ in range(rng.randrange(8, 80))]
        if bad:
            for _ in range(rng.randrange(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "!", "."]))
        if rng.random() < (share if bad else 0.05):
            w.insert(rng.randrange(len(w)), identity)
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def insulting(spark):
    rows, labels = toxic_rows(900, 5)
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_found_out(insulting):
    docs, labels = insulting
    model = toxicity.fit(docs, labels, lambda i: toxicity.learned(i, 5))
    held = ~toxicity.learned(F.col("doc_id"), 5)
    out = toxicity.score(docs, model, held.alias("held_out")).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_a_group_mention_alone_is_not_toxic(spark, insulting):
    docs, labels = insulting
    fair, plain = (toxicity.fit(docs, labels, lambda i: F.lit(True), fairness=f) for f in (10.0, 0.0))
    weight = lambda m, w: m.weights[m.features[w]]
    assert abs(weight(fair, "women") - weight(fair, "men")) < 0.2 * abs(weight(plain, "women") - weight(plain, "men"))
    neutral = "the women of n1 n2 n3 met n4 n5 n6"
    assert toxicity.Scorer(fair)(neutral) < min(0.5, toxicity.Scorer(plain)(neutral))


def test_stems_of_a_group_are_not_toxic_either(spark):
    """A swap changes the stems of a name as well, unless another word has them."""
    assert toxicity.swap([0, 1, 2], [3, 1, 4], []) == {0: -1, 2: -1, 3: 1, 4: 1}
    assert toxicity.swap([0, 1, 2], [3, 4], [2, 4]) == {0: -1, 1: -1, 3: 1}
    rows, labels = toxic_rows(900, 6, identity="muslims")
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole = lambda m, name: sum(m.weights[m.features[f]] for f in toxicity.word_features(name) if f in m.features)
    fair, plain = (toxicity.fit(docs, labels, lambda i: F.lit(True), fairness=f) for f in (10.0, 0.0))
    assert whole(plain, "muslims") - whole(plain, "christians") > 1
    assert abs(whole(fair, "muslims") - whole(fair, "christians")) < 0.2 * (whole(plain, "muslims") - whole(plain, "christians"))


@pytest.mark.parametrize("identity", ["women", "muslims", "immigrants"])
def test_scores_stay_when_a_name_is_swapped(spark, identity):
    rows, labels = toxic_rows(900, 7, identity=identity)
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fair, plain = (toxicity.Scorer(toxicity.fit(docs, labels, lambda i: F.lit(True), fairness=f)) for f in (10.0, 0.0))
    neutral = "the {} of n1 n2 n3 met n4 n5 n6"
    for other in ("christians", "refugees", "old"):
        own, swapped = (fair(neutral.format(w)) for w in (identity, other))
        assert abs(own - swapped) < 0.1 * max(own, swapped)
        assert plain(neutral.format(identity)) > 2 * plain(neutral.format(other))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([(fair(t) >= 0.5) == truth[i] for i, t in rows]) > 0.97


def test_scores_are_sums_of_weights(insulting, edge_rows, edge_docs):
    docs, labels = insulting
    model = toxicity.fit(docs, labels, lambda i: F.lit(True))
    want = Counter()
    for i, text, *_ in edge_rows:
        runs = {r for t in (text or "").lower().split() for r in "".join(c if c.isalpha() else " " for c in t).split()}
        found = runs | {r[:n] + "*" for r in runs for n in (3, 4, 5, 6) if len(r) > n}
        z = model.weights[-1] + sum(model.weights[k] for f, k in model.features.items() if f in found)
        want[i, round(float(1 / (1 + np.exp(-z))), 9)] += 1
    assert Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(edge_docs, model).collect()) == want


def test_stems_generalise(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(500):
        bad = k % 3 == 0
        w = [f"{rng.choice('abcd')}{rng.randrange(10**6)}" for _ in range(20)]
        w = ["".join(c if c.isalpha() else "klmnopqrst"[int(c)] for c in x) for x in w]
        if bad:
            w[3] = "vequ" + "".join(rng.choice("aeiou") for _ in range(5))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), lambda i: F.lit(True))
    assert toxicity.Scorer(model)("quite new vequxyz here") > 0.5 > toxicity.Scorer(model)("quite new words here")


def test_toxicity_edge_cases(spark, insulting, edge_rows, edge_docs, no_docs):
    docs, labels = insulting
    model = toxicity.fit(docs, labels, lambda i: F.lit(True))
    assert Counter(r.doc_id for r in toxicity.score(edge_docs, model).collect()) == Counter(r[0] for r in edge_rows)
    assert toxicity.score(no_docs, model).count() == 0
    kept = toxicity.filter_toxic(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == len(edge_rows)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    for some in (odd, labels.where("toxic = 1"), labels.limit(0)):
        model = toxicity.fit(docs, some, lambda i: F.lit(True))
        assert {r.predicted for r in toxicity.score(docs, model).collect()} <= {0, 1}


def test_filter_takes_the_toxic_alone(insulting):
    docs, labels = insulting
    model = toxicity.fit(docs, labels, lambda i: F.lit(True))
    kept = {r.doc_id for r in toxicity.filter_toxic(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert np.mean([(i in kept) == (t == 0) for i, t in truth.items()]) > 0.98


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] + 0.1 > 0, 1.0, -1.0)
    w = linear.svm([(np.flatnonzero(r), r[r != 0]) for r in x], y, 5)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


RANK_FILE, PATTERN = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_other_encoder(other):
    rng = random.Random(6)
    alphabet = "aab bAeéth \n\t1239日本👍🏽'st.,;<|endoftext|>ß"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(800)] + ["", "a" * 20_000, "ab" * 9_000, "the " * 5_000, "日" * 3_000, "   x"]
    c = bpe.Codec(RANK_FILE, PATTERN)
    for text, ids in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
        assert c.decode(ids) == text.encode()


def test_ranks_out_of_order():
    """Ranks under which a merge makes a pair of a lower rank than its own."""
    rng = random.Random(12)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 5))) for _ in range(14)}
        ranks = {t: i for i, t in enumerate(tokens)} | {t: 256 + i for i, t in enumerate(rng.sample(sorted(more), len(more)))}
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))).encode() for _ in range(40)]
        ref = tiktoken.Encoding("t", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
        assert bpe.MergeReplay(ranks).encode(words) == [ref.encode_ordinary(w.decode()) for w in words]


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_many_places_at_once(monkeypatch, few):
    """Runs of places that overlap, by arrays and one by one."""
    monkeypatch.setattr(bpe, "FEW", few)
    rng = random.Random(few)
    for _ in range(40):
        more = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 6))) for _ in range(20)} | {b"aa", b"aaa", b"aaaa"}
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(rng.sample(sorted(more), len(more)))}
        words = ["".join(rng.choice("aab") for _ in range(rng.randrange(1, 40))).encode() for _ in range(60)] + [b"a" * n for n in range(1, 40)]
        ref = tiktoken.Encoding("t", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
        assert bpe.MergeReplay(ranks).encode(words) == [ref.encode_ordinary(w.decode()) for w in words]


def test_tokens_of_edge_cases(other, edge_rows, edge_docs, no_docs):
    ids = lambda t: np.array(other.encode_ordinary(t or ""), "<u4")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids(t)), sha(ids(t).tobytes()), sha((t or "").encode())) for i, t, *_ in edge_rows)
    assert Counter(tuple(r) for r in bpe.round_trip(edge_docs, RANK_FILE, PATTERN).collect()) == want
    encoded = bpe.encode(edge_docs, RANK_FILE, PATTERN)
    assert Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded, RANK_FILE, PATTERN).collect()) == Counter((i, (t or "").encode()) for i, t, *_ in edge_rows)
    out = bpe.tokenized(edge_docs, RANK_FILE, PATTERN).collect()
    assert all(r.lossless and len(r.ids) == 4 * r.n_tokens for r in out)
    assert bpe.round_trip(no_docs, RANK_FILE, PATTERN).count() == bpe.tokenized(no_docs, RANK_FILE, PATTERN).count() == 0
