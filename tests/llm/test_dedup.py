"""Exact, near and line deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from millrace.llm import candidates
from millrace.llm import components as cc
from millrace.llm import exact_dedup, line_dedup, ngram_join

NO_ID = (1 << 63) - 1


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def joined(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact(edge_rows, edge_docs):
    groups = defaultdict(list)
    for i, text, *_ in edge_rows:
        groups[normal(text)].append(i)
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(edge_docs).collect())
    assert got == want


def test_drop_copies_leaves_one_each(edge_rows, edge_docs):
    kept = exact_dedup.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(r[1]) for r in edge_rows})


@pytest.mark.parametrize("budget", [200, 5_000, 1 << 30])
def test_grace_spills_and_compares_contents(budget):
    rng = random.Random(3)
    records = [(rng.choice([0, 1 << 62, -5, rng.randrange(-(1 << 63), 1 << 63)]), k, 1, f"text {rng.randrange(40)}".encode() * 20) for k in range(600)]
    records = [(hash(c) if k % 3 else 17, k, 1, c) for k, (_, _, _, c) in enumerate(records)]
    want = defaultdict(list)
    for h, k, _, c in records:
        want[h, c].append(k)
    got = {(r[0], r[3]): (r[1], r[2]) for r in exact_dedup.grace(records, budget)}
    assert got == {key: (min(ks), len(ks)) for key, ks in want.items()}


def shingle_sets(rows):
    out = []
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out.append((NO_ID if i is None else i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def near_brute(rows):
    sets = shingle_sets(rows)
    links = [(a, b) for a, (_, s) in enumerate(sets) for b, (_, t) in enumerate(sets[:a]) if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    home = joined(links, range(len(sets)))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[home[k]] = min(least.get(home[k], NO_ID), i)
    real = lambda i: None if i == NO_ID else i
    return Counter((real(i), len(s), real(least[home[k]]) if s else real(i)) for k, (i, s) in enumerate(sets))


def test_near(edge_rows, edge_docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(edge_docs).collect())
    assert got == near_brute(edge_rows)


def test_near_families_of_every_size(spark):
    """Chains of ever more different copies, and a family large enough to be a set, of which a part is only near to one another."""
    rng = random.Random(11)
    rows = []
    for n in (5, 6, 8, 12, 20, 45, 90, 200, 700):
        text = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(6):
            text = list(text)
            for _ in range(max(1, n // 60)):
                text[rng.randrange(n)] = f"y{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    base = [f"b{k}" for k in range(120)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(copy)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(len(rows) + k, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 60)))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(df).collect())
    assert got == near_brute(rows)


def test_near_short_texts(spark):
    """Short texts of every size, near copies of each among unlike ones; many blocks of such sets are empty."""
    rng = random.Random(21)
    rows = []
    for n in range(1, 41):
        for _ in range(8):
            text = [f"v{rng.randrange(10**6)}" for _ in range(n + 4)]
            rows.append((len(rows), " ".join(text)))
            for _ in range(3):
                copy = list(text)
                for _ in range(rng.randrange(1, 2 + n // 12)):
                    at = rng.choice([0, len(copy), rng.randrange(len(copy))])
                    copy[at : at + rng.randrange(2)] = [f"y{rng.randrange(10**6)}"] * rng.randrange(2)
                rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(df).collect())
    assert got == near_brute(rows)


def test_keys_have_content():
    """Unlike short sets share no key, near ones always do, by the other cuts as well."""
    rng = np.random.default_rng(2)
    seen = Counter()
    for n in range(3, 60):
        for _ in range(50):
            s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            seen.update(set(ngram_join._keys(s).tolist()))
            t = np.unique(np.r_[s[rng.permutation(n)[: n - n // 7]], rng.integers(0, 1 << 64, n // 7 if n > 13 else 0, dtype=np.uint64)])
            if 4 * len(np.intersect1d(s, t)) >= 3 * len(np.union1d(s, t)) and len(t) != n:
                for first in (0, 16):
                    assert set(ngram_join._keys(s, first).tolist()) & set(ngram_join._keys(t, first).tolist())
    assert max(seen.values()) == 1


def test_large_sets_are_cut_again(spark, monkeypatch):
    """Unlike texts that share a passage, among them some near copies, in sets that are too large for one task."""
    monkeypatch.setattr(candidates, "CHUNK", 8)
    monkeypatch.setattr(candidates, "LARGE", 16)
    rng = random.Random(31)
    passage = " ".join(f"p{k}" for k in range(80))
    rows = []
    for k in range(90):
        rows.append((len(rows), passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(28, 60)))))
        if k % 9 == 0:
            rows += [(len(rows) + j, rows[-1][1] + f" z{j}" * (j + 1)) for j in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(df).collect())
    assert got == near_brute(rows)


def kept_brute(rows):
    """(id, text) of the rows without shingles, and of one row of every other component: the smallest id, then any of its texts."""
    sets = shingle_sets(rows)
    links = [(a, b) for a, (_, s) in enumerate(sets) for b, (_, t) in enumerate(sets[:a]) if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    home, groups = joined(links, range(len(sets))), defaultdict(list)
    for k, (i, s) in enumerate(sets):
        groups[home[k] if s else ("alone", k)].append((i, rows[k][1]))
    return [{(None if i == NO_ID else i, t) for i, t in g if i == min(g, key=lambda r: r[0])[0]} for g in groups.values()]


def test_keep_one(edge_rows, edge_docs):
    kept = ngram_join.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    got, want = [(r.doc_id, r.text) for r in kept.collect()], kept_brute(edge_rows)
    assert len(got) == len(want)
    assert all(sum(r in w for r in got) >= 1 for w in want) and all(any(r in w for w in want) for r in got)


LONG_A, LONG_B = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(3, LONG_B + " tail"), (5, LONG_A), (5, LONG_B)], [(3, LONG_B + " tail"), (5, LONG_A)]),
        ([(3, LONG_B), (None, LONG_B + " tail"), (None, LONG_A)], [(3, LONG_B), (None, LONG_A)]),
        ([(5, LONG_A), (5, LONG_A), (6, LONG_A), (6, LONG_B), (7, None), (7, None)], [(5, LONG_A), (6, LONG_B), (7, None), (7, None)]),
    ],
)
def test_rows_go_not_ids(spark, rows, want):
    """An id that repeats, or is null, names no text."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in ngram_join.keep_one(docs).collect()) == Counter(want)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(docs).collect()) == near_brute(rows)


def test_ids_do_not_matter(spark):
    """Unique ids, no ids, and two ids give the same components."""
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        base = [f"v{rng.randrange(10**6)}" for _ in range(50)]
        texts += [" ".join([*base, f"x{j}"]) for j in range(3)]
    for ids in ([*range(450)], [None] * 450, [k % 2 for k in range(450)]):
        rows = list(zip(ids, texts, strict=True))
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == near_brute(rows)


def test_sketches_bound_the_difference():
    rng = random.Random(5)
    for _ in range(60):
        shared = [f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 300))]
        a, b = (" ".join(shared + [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 80))]).encode() for _ in range(2))
        s, t = ngram_join.shingles(a), ngram_join.shingles(b)
        differ = len(set(s.tolist()) ^ set(t.tolist()))
        assert ngram_join._differ(ngram_join._large(s), ngram_join._large(t)) <= differ
        if 7 * differ <= len(s) + len(t) and differ:
            assert set(ngram_join._keys(s).tolist()) & set(ngram_join._keys(t).tolist())


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(4000, 4040)]
    found = {r.node: r.comp for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = joined(links, {x for e in links for x in e if e[0] != e[1]})
    assert found == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = []
    materialize = cc.materialize
    monkeypatch.setattr(cc, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    rng = random.Random(3)
    mixed = rng.sample(range(1000, 1300), 300)
    links = [(k, k + 1) for k in range(300)] + list(zip(mixed, mixed[1:]))
    found = {r.node: r.comp for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(found.values()) == {0, 1000} and len(found) == 601 and made.count("links") <= 7 and made.count("hook") < 30


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def block_keys(lines):
    *_, n, sim, keys, owner = line_dedup.fingerprints(lines, True)
    out = [set() for _ in lines]
    for k, o in zip(keys.tolist(), owner.tolist(), strict=True):
        out[o].add(k)
    return out, n, sim


def similar_by_blocks(lines):
    """Pairs of different lines that share a block, are not too far apart and have an edit similarity of 0.9."""
    keys, n, sim = block_keys(lines)
    apart = lambda m: next(d for at, d in zip(reversed(line_dedup.LENGTHS), reversed(line_dedup.APART), strict=True) if m >= at)
    near = lambda a, b: min(n[a], n[b]) < line_dedup.COUNTED or ((int(sim[a]) ^ int(sim[b])) & (2**64 - 1)).bit_count() <= apart(max(n[a], n[b]))
    return [(a, b) for a in range(len(lines)) for b in range(a) if keys[a] & keys[b] and near(a, b) and 10 * edits(*line_dedup.unlike_parts(lines[a], lines[b])) <= max(len(lines[a]), len(lines[b]))]


def lines_brute(rows):
    """By row (id, text), the null id last: the lines that go."""
    first, seen = {}, []
    for i, text, *_ in rows:
        if text is not None:
            for k, raw in enumerate(text.split("\n")):
                r = line_dedup.reduced(raw)
                if r:
                    place = (NO_ID if i is None else i, key_of(text), k)
                    seen.append((i, text, r, place))
                    first[r] = min(first.get(r, place), place)
    distinct = sorted(first)
    home = joined(similar_by_blocks(distinct), range(len(distinct)))
    keep = {}
    for k, r in enumerate(distinct):
        keep[home[k]] = min(keep.get(home[k], first[r]), first[r])
    at = {r: keep[home[k]] for k, r in enumerate(distinct)}
    gone = defaultdict(set)
    for i, text, r, place in seen:
        if at[r] != place:
            gone[i, text].add(place[2])
    return gone


def key_of(text):
    return xxhash.xxh64_intdigest(text.encode(), 42) - (xxhash.xxh64_intdigest(text.encode(), 42) >> 63 << 64)


def line_rows():
    rng = random.Random(9)
    stock = [" ".join(f"k{rng.randrange(500)}" for _ in range(rng.randrange(2, 40))) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(stock)
            if rng.random() < 0.5:
                line = line.replace(" ", rng.choice([" ", ", ", "  "])).title()
            if rng.random() < 0.4:
                w = line.split()
                w[rng.randrange(len(w))] += rng.choice(["s", "!", "x"])
                line = " ".join(w)
            lines.append(line)
        rows.append((i, "\n".join([*lines, "", "!!"])))
    return rows


def test_lines(spark):
    rows = [*line_rows(), (100, None), (101, ""), (102, "\n\n"), (None, "a line of nobody\nanother such line"), (None, "a line of nobody"), (None, None), (7, line_rows()[7][1]), (103, "a line of nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = lines_brute(rows)
    want = Counter((i, 0 if t is None else t.count("\n") + 1, tuple(sorted(gone.get((i, t), ())))) for i, t in rows)
    assert Counter((r.doc_id, r.n_lines, tuple(r.dropped)) for r in line_dedup.dedup_report(df).collect()) == want
    texts = Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in line_dedup.drop_lines(df).collect()) == texts


def test_lines_of_edge_cases(edge_rows, edge_docs):
    gone = lines_brute(edge_rows)
    want = Counter((i, tuple(sorted(gone.get((i, t), ())))) for i, t, *_ in edge_rows)
    assert Counter((r.doc_id, tuple(r.dropped)) for r in line_dedup.dedup_report(edge_docs).collect()) == want
    assert line_dedup.drop_lines(edge_docs).columns == edge_docs.columns


def test_unlike_rows_of_one_id_keep_their_own_lines(spark):
    rows = [(0, "one two three four"), (1, "one two three four\nalpha beta gamma"), (1, "precious unique words here\nzulu yankee")]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(0, "one two three four"), (1, "alpha beta gamma"), rows[2]])


def test_large_sets_of_lines(spark, monkeypatch):
    """Lines that share their first half, too many for one task; similar only in part."""
    monkeypatch.setattr(candidates, "CHUNK", 8)
    monkeypatch.setattr(candidates, "LARGE", 16)
    rng = random.Random(17)
    rows = [(k, " ".join(["every line begins with these words"] + [f"m{rng.randrange(10**4)}" for _ in range(rng.randrange(4, 8))])) for k in range(80)]
    rows += [(100 + k, rows[k][1] + "x" * (k % 3)) for k in range(0, 80, 4)]
    gone = lines_brute(rows)
    out = line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: set(r.dropped) for r in out} == {i: gone.get((i, t), set()) for i, t in rows} and gone


def test_long_lines_with_a_common_passage(spark, monkeypatch):
    """Lines that share a third of their letters and are not similar are ruled out where both lie: few of their pairs are joined with their texts."""
    rng, compared, similar = random.Random(8), [], line_dedup.similar

    def counted(pairs):
        compared.append(pairs.count())
        return similar(pairs)

    monkeypatch.setattr(line_dedup, "similar", counted)
    stock = ["".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    some = lambda k: " ".join(rng.choice(stock) for _ in range(k))
    passage = some(40)
    lines = [f"{some(40)} {passage} {some(k % 7)}" for k in range(120)]
    lines += [x.replace(" t", " q", 3) for x in lines[:20]]
    out = line_dedup.dedup_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in out if r.dropped} == set(range(120, 140)) and sum(compared) < 1500


def test_stretches_rule_out_no_similar_pair():
    """Edits anywhere, line by line to the tenth, in short lines, long ones and such as are looked at in part."""
    rng = random.Random(3)
    left, right, unlike = [], [], []
    for n in (5, 63, 64, 65, 130, 300, 700, 2048, 2300):
        for _ in range(4):
            x = [rng.choice("etaoin shr\u00e9\u4eca1") for _ in range(n)]
            y, most = list(x), n // 10
            for _ in range(rng.choice([0, most // 2, most])):
                at = rng.randrange(len(y))
                y[at : at + rng.randrange(2)] = rng.choice([[], ["z"], [rng.choice("etao")]])
            x, y = "".join(x), "".join(y)
            if edits(x, y) <= max(len(x), len(y)) // 10:
                left += [x, y]
                right += [y, x]
            unlike.append("".join(rng.choice("etaoin shr") for _ in range(n)))
    lines = lambda side: [{"head": x[: line_dedup.HEAD], "chars": len(x)} for x in side]
    each = np.arange(len(left))
    assert len(left) > 40 and line_dedup._not_far(lines(left), lines(right), each, each).all()
    long = [x for x in unlike if len(x) >= 130]
    at = np.array([(i, j) for i in range(len(long)) for j in range(len(long)) if i != j and 300 <= len(long[i]) == len(long[j])]).T
    assert not line_dedup._not_far(lines(long), lines(long), *at).any()


def typos(rng, line, k):
    """line with so many letters of unlike words changed, added or left out, and at times a word put in or left out."""
    w = line.split()
    for at in rng.sample(range(len(w)), min(k, len(w))):
        p = rng.randrange(len(w[at]))
        w[at] = rng.choice([w[at][:p] + rng.choice("abcdefghij") + w[at][p + 1 :], w[at][:p] + rng.choice("abcdefghij") + w[at][p:], w[at][:p] + w[at][p + 1 :] or "q"])
    if rng.random() < 0.1:
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[], [w[at], "an"]])
    return " ".join(w)


@pytest.mark.parametrize("words", [4, 5, 6, 8, 11, 12, 15, 18, 20, 40, 80])
@pytest.mark.parametrize("changes", [1, 2, 3])
def test_recall_by_length(words, changes):
    """Of pairs with an edit similarity of 0.9, by a distance that shares nothing with the operator, at least 0.9 are found at every length; of four words two are to be left as they were."""
    rng = random.Random(100 * words + changes)
    total = found = 0
    for _ in range(60 if words < 40 else 12):
        x = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 11))) for _ in range(words))
        y = typos(rng, x, changes)
        if x != y and 10 * edits(x, y) <= max(len(x), len(y)):
            total += 1
            found += bool(similar_by_blocks([x, y]))
    assert found >= (0.9 if words > 4 or changes < 3 else 0) * total, (found, total)


def test_against_all_pairs(spark):
    """Groups of the whole operator against those of all pairs of lines."""
    rng = random.Random(77)
    lines = []
    for _ in range(45):
        base = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(rng.choice([4, 6, 9, 13, 17, 30])))
        lines += [base, *(typos(rng, base, rng.randrange(1, 4)) for _ in range(rng.randrange(3)))]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if 10 * edits(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b]))]
    out = {r.doc_id: bool(r.dropped) for r in line_dedup.dedup_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    home = joined(links, range(len(lines)))
    first = {}
    for k in range(len(lines)):
        first.setdefault(home[k], k)
    gone = {k for k in range(len(lines)) if first[home[k]] != k}
    assert {k for k, d in out.items() if d} <= gone and sum(out.values()) >= 0.9 * len(gone) > 20


def test_letters_bound_the_edits():
    """Similar short lines always pass the screen."""
    rng = random.Random(5)
    for _ in range(300):
        x = " ".join("".join(rng.choice("abcdeféß日0") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(2, 25)))
        y = typos(rng, x, rng.randrange(1, 5))
        if 10 * edits(x, y) <= max(len(x), len(y)):
            _, _, _, n, sim = line_dedup.fingerprints([x, y])
            assert len(n) == 2 and line_dedup._possible(n[:1], sim[:1].view(np.uint64), n[1:], sim[1:].view(np.uint64))[0][0] or max(n) >= line_dedup.COUNTED


def test_lines_without_spaces(spark):
    """Scripts that do without spaces, and one long word."""
    line = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u4e00\u8d77\u53bb\u516c\u56ed\u6563\u6b65\u5427\u4e0d\u8981\u5fd8\u8bb0\u5e26\u4e0a\u96e8\u4f1e"
    url = "https://example.org/" + "0123456789abcdef" * 6
    assert similar_by_blocks([line, line[:9] + "\u7684" + line[9:]]) and similar_by_blocks([url + "7", url + "8"])


def test_fingerprints(monkeypatch):
    """Punctuation, blanks and case do not matter; order does; long lines, whose counters are summed in pieces, count every word."""
    texts = ["A-b,  c\n\n!!\nc ab", "ab c", "é Ü\tx\ry", "", "c AB."]
    text, line, ref, n, sim = line_dedup.fingerprints(texts)
    assert list(zip(text.tolist(), line.tolist())) == [(0, 0), (0, 3), (1, 0), (2, 0), (4, 0)]
    assert ref[0] == ref[2] != ref[1] == ref[4] and sim[0] == sim[1]
    assert n.tolist() == [len(line_dedup.reduced(x)) for x in ("A-b,  c", "c ab", "ab c", "é Ü\tx\ry", "c AB.")]
    monkeypatch.setattr(line_dedup, "COUNTED", 0)  # all sketches are SimHashes
    rng = random.Random(4)
    words = [f"w{rng.randrange(9)}" for _ in range(1000)]
    one = dict(zip(sorted(set(words)), line_dedup.fingerprints(sorted(set(words)))[4].tolist(), strict=True))
    want = sum(1 << b for b in range(64) if sum(1 if one[w] >> b & 1 else -1 for w in words) > 0)
    assert int(line_dedup.fingerprints([" ".join(words)])[4][0]) & (2**64 - 1) == want


def test_punctuation_and_blanks_beyond_ascii(spark):
    same = ['He said "no" - it is late... 10 %', "he\u00a0said \u201cno\u201d \u2013 it is\u3000late\u2026 10\u202f%", "He\u2003said \u00abno\u00bb \u2014 it\u2028is\x1clate\u3002 10\u2009\u066a"]
    assert {line_dedup.reduced(x) for x in same} == {"he said no it is late 10"}
    assert len(set(line_dedup.fingerprints(same)[2].tolist())) == 1
    found = line_dedup.dedup_report(spark.createDataFrame(list(enumerate(same)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.dropped for r in found} == {0: [], 1: [0], 2: [0]}
    rng = random.Random(3)
    stock = [chr(c) for c in (*range(10), *range(11, 0x370), *range(0x2000, 0x2070), *range(0x3000, 0x3040))]
    for _ in range(500):
        line = "".join(rng.choice(stock) for _ in range(60))
        want = " ".join(w for w in ("".join(c for c in x if c.isalnum()) for x in line.lower().split()) if w)
        assert line_dedup.reduced(line) == want and line_dedup.fingerprints([line])[3].tolist() == [len(want)] * bool(want)


def test_words_bound_the_edits():
    rng = random.Random(13)
    for _ in range(400):
        a = [rng.choice(["ab", "c", "def", "g"]) for _ in range(rng.randrange(1, 12))]
        b = [w for w in a if rng.random() < 0.9]
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(["x", "ab", "yz"]))
        x, y = " ".join(a), " ".join(b)
        assert line_dedup.edits_at_most(x, y, 1000) >= edits(x, y)
        assert edits(*line_dedup.unlike_parts(x, y)) == edits(x, y)
    assert line_dedup.edits_at_most("a b c", "a b c", 0) == 0 and line_dedup.edits_at_most("aa bb cc", "aa xx cc", 9) == 2


def test_distance():
    rng = random.Random(19)
    for _ in range(500):
        x, y = ("".join(rng.choice("abé") for _ in range(rng.randrange(40))) for _ in range(2))
        want = edits(x, y)
        for most in (0, want - 1, want, 100):
            got = line_dedup.distance(x, y, most)
            assert got == want if want <= most else got > most


def test_similar(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randrange(40))), "".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for _ in range(200)]
    rows += [(a, a[: len(a) // 2] + "é" + a[len(a) // 2 :]) for a, _ in rows]
    df = spark.createDataFrame([(k, k, *r) for k, r in enumerate(rows)], "a long, b long, x string, y string")
    near = {r.a for r in line_dedup.similar(df).collect()}
    assert near == {k for k, (x, y) in enumerate(rows) if 10 * edits(x, y) <= max(len(x), len(y))}


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert ngram_join.near_components(no_docs).count() == 0
    assert ngram_join.keep_one(no_docs).count() == 0
    assert line_dedup.dedup_report(no_docs).count() == 0


def test_members_of_a_set_are_screened_together(monkeypatch):
    """Members of a set that have no possible partner go, without a call for each of them; the rest is as by pairs."""
    import pyarrow as pa

    rng, calls, possible = np.random.default_rng(5), [], line_dedup._possible
    n = rng.integers(10, 400, 300).astype(np.uint32)
    sim = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sim[::3] = sim[0]
    ref = np.arange(1, 301, dtype=np.int64)
    size = n.astype(np.int64)
    kept = ref[[possible(size, sim, size[k], sim[k : k + 1])[0].sum() > 1 for k in range(300)]]
    monkeypatch.setattr(line_dedup, "_possible", lambda *a: (calls.append(1), possible(*a))[1])
    packed = b"".join(x.tobytes() for x in (np.full(300, 7, np.uint64), ref, n, sim))
    rows = [r for b in line_dedup._candidates(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([packed])], names=["bucket", "data"])])) for r in b.to_pylist()]
    assert sorted(r["b"] for r in rows) == sorted(kept.tolist()) and 2 < len(kept) < 300
    assert len(calls) <= 10


def test_lines_that_are_nearly_similar_are_settled_where_they_lie(spark, monkeypatch):
    """Of a family whose lines are similar by a hair or not, only those compared with the center are rows; what links them is found all the same."""
    rng, compared, similar = random.Random(5), [], line_dedup.similar

    def counted(pairs):
        compared.append(pairs.count())
        return similar(pairs)

    monkeypatch.setattr(line_dedup, "similar", counted)
    base = " ".join("".join(rng.choice("etaoinshrdl") for _ in range(4)) for _ in range(40))
    rows = []
    for k in range(40):
        x = list(base)
        for at in rng.sample([p for p in range(100, len(base)) if base[p] != " "], 12):
            x[at] = rng.choice("0123456789")
        rows.append((k, "".join(x)))
    gone = lines_brute(rows)
    out = line_dedup.dedup_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: set(r.dropped) for r in out} == {i: gone.get((i, t), set()) for i, t in rows} and 0 < len(gone) < 39
    assert sum(compared) < 2 * len(rows)


def test_settled_looks_at_few_pairs_of_what_is_one():
    """Two components of many members: one link joins them. Where there is none, every pair is looked at."""
    looked, n = [], 60
    alike = lambda x, y, i, j: (looked.append(len(i)), np.array([x[a] == y[b] for a, b in zip(i, j, strict=True)], bool))[1]
    pairs = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    for other, most, links in ((7, 1, 1), (8, n * n, 0)):
        looked.clear()
        found, unsure = candidates._settled([(k, 1, True, 7) for k in range(n)], [(n + k, 2, True, other) for k in range(n)], *pairs, {}, alike)
        assert (len(found), len(unsure), sum(looked)) == (links, 0, most)
    found, unsure = candidates._settled([(0, 1, False, 7)], [(1, 2, True, 7)], np.array([0]), np.array([0]), {}, alike)
    assert not len(found) and unsure.tolist() == [0]


def test_distances_in_a_band(monkeypatch):
    """Lines about as far apart as the limit, of one to four numbers a band, with letters of all widths."""
    rng, pairs = random.Random(9), []
    for n in (1, 9, 10, 63, 64, 65, 200, 319, 320, 640, 700):
        for share in (0.0, 0.8, 1.0, 1.2, 3.0):
            for _ in range(6 if n < 300 else 2):
                x = [rng.choice("etaoin shré今\U0001f600"[: rng.choice([4, 12])]) for _ in range(n)]
                y = list(x)
                for _ in range(int(share * n / 10) + rng.randrange(2)):
                    at = rng.randrange(len(y) + 1)
                    y[at : at + rng.randrange(2)] = rng.choice([[], ["z"], [rng.choice("etao")]])
                pairs += [("".join(x), "".join(y) or "a")] * (2 if n < 300 else 1)
    want = [10 * edits(*line_dedup.unlike_parts(x, y)) <= max(len(x), len(y)) for x, y in pairs]
    for few in (0, 1 << 20):
        monkeypatch.setattr(line_dedup, "FEW", few)
        assert line_dedup._banded(pairs).tolist() == want and line_dedup._close(pairs).tolist() == want
    assert 20 < sum(want) < len(want) - 20
