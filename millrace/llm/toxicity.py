"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the presence of words and word stems. Where a labelled text names a group
of people, the name is swapped for that of every other group in the list, and the change of the score
by all features of the two names, stems included, is penalised, so that the name alone cannot make a text toxic. The features are chosen by their
association with the labels; a bounded sample of labelled rows serves for both.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import discard, keep_alone, materialize
from .linear import logistic

IDENTITY_TERMS = ("women", "men", "muslims", "muslim", "christians", "christian", "jews", "jewish", "hindus", "atheists", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "immigrants", "refugees", "disabled", "deaf", "blind", "old", "young", "frauen", "männer", "muslime", "christen", "juden", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "mujeres", "hombres", "musulmanes", "cristianos", "judíos")
STEMS = (3, 4, 5, 6)
MAX_CACHED = 1 << 18
_LETTERS = re.compile(r"[^\W\d_]+")
_SCORERS: dict[int, Scorer] = {}


class Model(NamedTuple):
    features: dict[str, int]
    weights: np.ndarray  # the last is the bias
    key: int


def word_features(token: str) -> list[str]:
    """The words of a token (as split at white space, lower case) and their stems."""
    out = []
    for run in _LETTERS.findall(token):
        out.append(run)
        out += [run[:n] + "*" for n in STEMS if len(run) > n]
    return out


def text_features(text: str) -> set[str]:
    return {f for token in set(text.lower().split()) for f in word_features(token)}


def sample(docs: DataFrame, labels: DataFrame, learn, per_class: int) -> DataFrame:
    """Texts and labels of at most per_class labelled rows of each class, the first by a hash of the id."""
    known = labels.select(labels["doc_id"].cast("long").alias("_mr_id"), labels["toxic"].cast("int").alias("toxic")).where("_mr_id is not null and toxic in (0, 1)").where(learn(F.col("_mr_id")))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("_mr_id"), "_mr_id").limit(per_class) for k in (0, 1)]
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), F.col("doc_id") == F.col("_mr_id")).select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: dict[str, list[int]] = {}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for f in text_features(text):
                tally.setdefault(f, [0, 0])[toxic] += 1
    names, pairs = list(tally), list(tally.values())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["f", "n0", "n1"])


def _design(features: dict[str, int], identity: Sequence[str]):
    """Of each text its features, the terms it names, and for each of these the features of any term that stay when this one goes."""
    terms = frozenset(identity)
    movable = {f for t in terms for f in word_features(t)} & features.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, named, others = [], [], []
            for text in batch.column(1).to_pylist():
                words = set(_LETTERS.findall(" ".join(text.lower().split())))
                suppliers = {w: found for w in words if (found := movable.intersection(word_features(w)))}
                rows.append(sorted(features[f] for f in text_features(text) if f in features))
                own = sorted(words & terms, key=features.__getitem__)
                named.append([features[t] for t in own])
                others.append([sorted({features[f] for w, found in suppliers.items() if w != t for f in found}) for t in own])
            columns = (pa.array(rows, pa.list_(pa.int32())), pa.array(named, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["toxic", "found", "named", "others"])

    return run


def swap(old: Sequence[int], new: Sequence[int], others: Sequence[int]) -> dict[int, int]:
    """How a text's features change when a term with the features old gives way to one with the features new; others are those that the rest of the text has."""
    gone, come = set(old).difference(others), set(new).difference(others)
    return {**dict.fromkeys(sorted(gone - come), -1), **dict.fromkeys(sorted(come - gone), 1)}


def fit(docs: DataFrame, labels: DataFrame, learn, identity: Sequence[str] = IDENTITY_TERMS, per_class: int = 4000, n_features: int = 1024, fairness: float = 10.0, l2: float = 0.0002) -> Model:
    """Fit on at most per_class labelled rows of each class. Without rows of both classes the score is the share of toxic ones (0 without any)."""
    rows = materialize(sample(docs, labels, learn, per_class), "toxicity-sample")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        discard(rows)
        bias = 35.0 if n1 else -35.0
        return Model({}, np.array([bias]), zlib.crc32(np.array([bias]).tobytes()))
    tally = rows.select("toxic", "text").mapInArrow(_counts, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    a, b, share = F.col("a"), F.col("b"), n1 / (n0 + n1)
    total = a + b
    gain = part(a, total * (1 - share)) + part(b, total * share) + part(n0 - a, (n0 + n1 - total) * (1 - share)) + part(n1 - b, (n0 + n1 - total) * share)
    best = tally.where(total >= min(5, max(2, n1 // 20))).withColumn("gain", F.round(gain, 9)).orderBy(F.desc("gain"), F.length("f"), "f").limit(n_features).collect()
    names = [r.f for r in best if r.gain > 4]
    names += [t for t in identity if t not in set(names)]
    features = {f: i for i, f in enumerate(names)}
    design = rows.select("toxic", "text").mapInArrow(_design(features, identity), "toxic int, found array<int>, named array<int>, others array<array<int>>").orderBy("toxic", "found", "named", "others").collect()
    discard(rows)
    x, y = np.zeros((len(design), len(features))), np.array([r.toxic for r in design], float)
    moves, terms = Counter(), {features[t]: [features[f] for f in word_features(t) if f in features] for t in identity}
    for i, r in enumerate(design):
        x[i, r.found] = 1
        for t, others in zip(r.named, r.others, strict=True):
            for other in terms:
                if other not in r.named:
                    # The whole change, and that of the names without their stems, so that these cannot make up for one another.
                    moves[tuple(swap(terms[t], terms[other], others).items())] += 1
                    moves[(t, -1), (other, 1)] += 1
    # Equal changes are one row, which weighs as much as they do.
    d, total = np.zeros((len(moves), len(features))), sum(moves.values()) // 2
    for i, (move, times) in enumerate(moves.items()):
        for at, v in move:
            d[i, at] = v * np.sqrt(times * len(moves) / total)
    w = logistic(x, y, d, l2, fairness)
    return Model(features, w, zlib.crc32(w.tobytes() + repr(names).encode()))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def __call__(self, text: str) -> float:
        known, found = self.known, set()
        for token in set(text.lower().split()):
            hits = known.get(token)
            if hits is None:
                if len(known) > MAX_CACHED:
                    known.clear()
                hits = known[token] = tuple(i for f in word_features(token) if (i := self.model.features.get(f)) is not None)
            if hits:
                found.update(hits)
        z = self.model.weights[-1] + sum(self.model.weights[i] for i in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def score(docs: DataFrame, model: Model, *keep) -> DataFrame:
    """doc_id, the columns keep, score (0 to 1) and predicted (1 from 0.5 on) of every whole text; null counts as empty. Rows that repeat are answered each, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("toxicity", _SCORERS.clear)
        if model.key not in _SCORERS:
            _SCORERS[model.key] = Scorer(model)
        scorer = _SCORERS[model.key]
        for batch in batches:
            scores = [scorer(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*batch.schema.names[1:], "score", "predicted"])

    rows = docs.select(F.coalesce(docs["text"], F.lit("")).alias("_mr_text"), docs["doc_id"].cast("long").alias("doc_id"), *keep)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[1:]) + ", score double, predicted int"
    return rows.mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose whole text scores 0.5 or more."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("toxicity", _SCORERS.clear)
        if model.key not in _SCORERS:
            _SCORERS[model.key] = Scorer(model)
        scorer, at = _SCORERS[model.key], names.index("text")
        for batch in batches:
            yield batch.filter(pa.array([scorer(t or "") < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)


def learned(doc_id, folds: int):
    """Whether a row may be learned from: crc32 of its id, as text, is no multiple of folds."""
    return (F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds) != 0


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, lambda i: learned(i, 5))
    return score(docs, model, (~learned(docs["doc_id"], 5)).alias("held_out"))


SQL: dict[str, str] = {}
