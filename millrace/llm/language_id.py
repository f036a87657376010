"""Language identification by hierarchical discrimination.

One-versus-one linear support vector machines choose a language family; others, trained within the
family alone, choose among its closely related languages. Languages in no listed family are families of
their own, or, if they are many, are put together by their likeness into about as many families as have
languages each, so that the machines stay few. The features are hashed character n-grams
of words, so a word adds the same to every machine wherever it stands, and a text is scored by
looking up its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import keep_alone
from .linear import Sparse, svm

FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic"}
DIM = 1 << 13
MAX_CACHED = 1 << 19
TABLE_BYTES = 64 << 20  # of the words that a worker keeps
OWN_FAMILIES = 8
_LETTERS = re.compile(r"[^\W\d_]+")
_SCORERS: dict[int, Scorer] = {}


class Model(NamedTuple):
    """pairs: (family or "" for the choice of family, first, second), the machine's columns of weights (DIM + 1, pairs)."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    scale: np.ndarray
    key: int


class _Numbers(dict):
    """Feature numbers of n-grams; only n-grams that occurred are kept, and not too many."""

    def __missing__(self, gram: str) -> int:
        if len(self) > MAX_CACHED:
            self.clear()
        self[gram] = at = zlib.crc32(gram.encode()) % DIM
        return at


_NUMBERS = _Numbers()


def _grams(token: str) -> list[int]:
    out = []
    for run in _LETTERS.findall(token):
        run = run if run.isalpha() else "".join(filter(str.isalpha, run))  # ² and ½ are no letters
        if not run:
            continue
        p = f"^{run}$"
        out += map(_NUMBERS.__getitem__, [*p, *map("".join, zip(p, p[1:])), *map("".join, zip(p, p[1:], p[2:]))])
    return out


def _features(text: str) -> Sparse:
    counts = Counter(at for token in text.lower().split() for at in _grams(token))
    at = np.array(sorted(counts), np.int64)
    return at, np.array([counts[k] for k in at.tolist()], float) / max(1, counts.total())


def sample(docs: DataFrame, learn, per_language: int, max_chars: int) -> list:
    """At most per_language rows of each language, of at most max_chars in all or little more, the same in every run.

    Rows are thinned by a hash of id and text, each language by how many different rows it has, so that
    null or repeated ids and texts cost no language its share; then the first of each language are taken.
    """
    row = F.xxhash64("doc_id", "text")
    known = docs.where(learn & docs["lang"].isNotNull() & docs["text"].isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(row).alias("n"), F.avg(F.length("text")).alias("chars")).collect()
    if not counts:
        return []
    want = max(1, min(per_language, int(max_chars / sum(r.chars + 1 for r in counts))))
    part = F.lit(False)
    for r in counts:
        part = part | ((F.col("lang") == r.lang) & (F.pmod(row, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.3 * want / max(1, r.n))) + 1))
    order = [F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")), "doc_id", F.sha2("text", 256)]
    first = known.where(part).dropDuplicates(["lang", "doc_id", "text"]).withColumn("_mr_rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_mr_rank") <= want)
    return sorted(first.collect(), key=lambda r: (r.lang, r["_mr_rank"]))


def _grouped(langs: list[str], rows: list[Sparse], of: list[str], families: Mapping[str, str]) -> dict[str, str]:
    """The family of each language. Those in no listed one, if more than OWN_FAMILIES, go to the most alike of a few that are unlike one another."""
    home = {v: families.get(v, v) for v in langs}
    rest = [v for v in langs if v not in families]
    if len(rest) <= OWN_FAMILIES:
        return home
    center = {v: np.zeros(DIM) for v in rest}
    for (at, x), v in zip(rows, of, strict=True):
        if v in center:
            center[v][at] += np.sqrt(x)
    c = np.array([center[v] / max(1e-12, np.linalg.norm(center[v])) for v in rest])
    seeds, near = [0], c @ c[0]
    while len(seeds) ** 2 < len(rest):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, c @ c[seeds[-1]])
    return home | {v: rest[seeds[k]] for v, k in zip(rest, (c @ c[seeds].T).argmax(1).tolist(), strict=True)}


def fit(docs: DataFrame, learn, families: Mapping[str, str] = FAMILIES, per_language: int = 400, max_chars: int = 24 << 20) -> Model:
    """Fit on a bounded sample of the rows for which learn holds, the same in every run."""
    sampled = sample(docs, learn, per_language, max_chars)
    rows, of = [_features(r.text) for r in sampled], [r.lang for r in sampled]
    total, squares = np.zeros(DIM), np.zeros(DIM)
    for at, v in rows:
        total[at] += v
        squares[at] += v * v
    n = max(1, len(rows))
    scale = 1 / (np.sqrt(np.maximum(0, squares / n - (total / n) ** 2)) + 1e-4) / np.sqrt(DIM) if rows else np.ones(DIM)
    home = _grouped(sorted(set(of)), rows, of, families)
    rows = [(at, v * scale[at]) for at, v in rows]
    kin = [home[v] for v in of]
    groups = {f: sorted({v for v, k in home.items() if k == f}) for f in sorted(set(home.values()))}
    pairs, columns = [], []
    for at, names, labels in [("", sorted(groups), kin), *((f, members, of) for f, members in groups.items())]:
        members = {name: [k for k, v in enumerate(labels) if v == name] for name in names}
        for a, b in combinations(names, 2):
            pairs.append((at, a, b))
            columns.append(svm([rows[k] for k in members[a] + members[b]], np.r_[np.ones(len(members[a])), -np.ones(len(members[b]))], DIM))
    weights = np.array(columns).T if columns else np.zeros((DIM + 1, 0))
    return Model(groups, pairs, weights, scale, zlib.crc32(weights.tobytes() + repr(groups).encode()))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.per_gram = model.weights[:-1] * model.scale[:, None]
        self.most = min(MAX_CACHED, TABLE_BYTES // (8 * (self.per_gram.shape[1] + 1)))
        self.machines: dict[str, list[tuple[int, str, str]]] = {}
        for k, (at, a, b) in enumerate(model.pairs):
            self.machines.setdefault(at, []).append((k, a, b))
        self.reset()

    def reset(self) -> None:
        """Forget all words. table: a row for each, its sums over its n-grams and their number."""
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, self.per_gram.shape[1] + 1))

    def learn(self, tokens: list[str]) -> None:
        """Add the tokens, which are new, to the table."""
        grams = [_grams(w) for w in tokens]
        begin, n = len(self.index), np.array([len(g) for g in grams])
        while begin + len(tokens) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        rows = self.table[begin : begin + len(tokens)]
        rows[:] = 0
        rows[:, -1] = n
        if n.any():
            flat = np.fromiter((v for g in grams for v in g), np.int64, n.sum())
            rows[n > 0, :-1] = np.add.reduceat(self.per_gram[flat], (np.cumsum(n) - n)[n > 0], axis=0)
        self.index.update(zip(tokens, range(begin, begin + len(tokens)), strict=True))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.index) > self.most:
            self.reset()
        places, ends = [], []
        for t in texts:
            tokens = t.lower().split()
            fresh = list(set(tokens).difference(self.index))
            if fresh:
                self.learn(fresh)
            places += map(self.index.__getitem__, tokens)
            ends.append(len(places))
        width = self.per_gram.shape[1] + 1
        sums = np.zeros((len(texts), width))
        if places:
            flat = np.array(places)
            begin = np.array([0, *ends[:-1]])
            some = np.array(ends) > begin
            sums[some] = np.add.reduceat(self.table[flat], begin[some], axis=0)
        grams = sums[:, -1]
        margins = sums[:, :-1] / np.maximum(grams, 1)[:, None] + self.model.weights[-1]
        langs, scores = [], []
        for g, m in zip(grams, margins, strict=True):
            lang, score = self._choose(m) if g > 0 and self.model.families else ("und", 0.0)
            langs.append(lang)
            scores.append(score)
        return langs, scores

    def _choose(self, margins: np.ndarray) -> tuple[str, float]:
        family, p = self._vote("", sorted(self.model.families), margins)
        lang, q = self._vote(family, self.model.families[family], margins)
        return lang, p * q

    def _vote(self, at: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        won = {n: [0, 0.0, 1.0] for n in names}
        for k, a, b in self.machines.get(at, ()):
            m = margins[k]
            for n, s in ((a, m), (b, -m)):
                won[n][0] += s > 0
                won[n][1] += s
                won[n][2] = min(won[n][2], 1 / (1 + np.exp(-2 * np.clip(s, -15, 15))))
        best = max(names, key=lambda n: (won[n][0], won[n][1], n))
        return best, float(won[best][2])


def identify(docs: DataFrame, model: Model, *keep) -> DataFrame:
    """doc_id, the columns keep, lang_pred and score of every whole text. `und` and 0.0 for a text that is null or has no letter. Rows that repeat are answered each, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("language", _SCORERS.clear)
        if model.key not in _SCORERS:
            _SCORERS[model.key] = Scorer(model)
        scorer = _SCORERS[model.key]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores = scorer.score(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.coalesce(docs["text"], F.lit("")).alias("_mr_text"), docs["doc_id"].cast("long").alias("doc_id"), *keep)
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[1:]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = (F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(0)) % 4) == 2
    return identify(docs, fit(docs, ~held_out), held_out.alias("held_out"))


SQL: dict[str, str] = {}
