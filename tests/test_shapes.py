"""Shapes of types against a recursive fold."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from millrace.operators import shapes

REFS, CHILDREN, NAMES = "ref long, form string, name string, length int", "ref long, pos int, child long", "name string, kind string, form string, class string, bits int, target long"
KNOWN = [("byte", "builtin", "scalar", "uint", 8, None), ("long", "builtin", "scalar", "int", 64, None), ("List", "builtin", "list", None, None, None), ("S", "sum", None, None, None, None), ("P", "declared", None, None, None, None), ("T", "param", None, None, None, None)]


def fold(refs, children, names):
    """Every reference to its shape as nested tuples."""
    nodes, known = {r[0]: r for r in refs}, {n[0]: n for n in names}
    kids = {}
    for ref, pos, child in sorted(set(children)):
        if child in nodes:
            kids.setdefault(ref, []).append((pos, child))

    def form_of(ref):
        _, form, name, _ = nodes[ref]
        if form != "named":
            return form
        kind = known.get(name, (None, None))[1]
        return {"builtin": known.get(name, (0,) * 6)[2], "declared": "reference", "sum": "sum", "param": "parameter", "alias": "alias"}.get(kind, "opaque")

    def ill(ref, path):
        if ref in path:
            return True
        below = [known[nodes[ref][2]][5]] if form_of(ref) == "alias" else [c for _, c in kids.get(ref, [])]
        return any(ill(c, (*path, ref)) for c in below if c in nodes)

    def one(ref):
        _, _, name, length = nodes[ref]
        form = form_of(ref)
        named = form in ("reference", "sum", "opaque", "parameter")
        if form == "alias":
            target = known[name][5]
            return ("opaque", None, None, None, name, ()) if target not in nodes or ill(ref, ()) else one(target)
        k = kids.get(ref, [])
        if form in ("array", "stream"):
            k = [x for x in k if x[0] == 0]
        if form in ("scalar", "bool", "text", "bytes", "dynamic", "opaque", "parameter"):
            k = []
        if form in ("optional", "list", "array", "stream", "borrow") and len(k) != 1 or form == "map" and len(k) != 2:
            return ("opaque", None, None, None, name if named else form, ())
        elems = tuple(one(c) for _, c in k)
        if form == "list" and elems[0][:3] == ("scalar", "uint", 8):
            return ("bytes", None, None, None, None, ())
        kind = known[name] if nodes[ref][1] == "named" and name in known and known[name][1] == "builtin" else (None,) * 6
        return (form, kind[3], kind[4], length if form == "array" else None, name if named else None, elems)

    return {ref: one(ref) for ref in nodes}


def height(shape):
    return 1 + max(map(height, shape[5])) if shape[5] else 0


def check(spark, refs, children, names):
    of, found = shapes.folded(spark.createDataFrame(refs, REFS), spark.createDataFrame(children, CHILDREN), spark.createDataFrame(names, NAMES))
    of, found = {r.ref: r.shape for r in of.collect()}, {r["shape"]: r for r in found.collect()}
    want = fold(refs, children, names)

    def tuple_of(digest):
        r = found[digest]
        return (r.form, r["class"], r.bits, r["length"], r.name, tuple(map(tuple_of, r.elems)))

    assert {k: tuple_of(v) for k, v in of.items()} == want
    assert len(found) == len({s for shape in want.values() for s in parts(shape)}) and all(found[of[k]].height == height(s) for k, s in want.items())
    return of, found


def parts(shape):
    return {shape}.union(*map(parts, shape[5]))


def test_terms_at_random(spark):
    """Shared subterms, aliases of aliases, circles, wrong numbers of children and children that are missing."""
    rng = random.Random(2)
    refs, children, names = [], [], list(KNOWN)
    for k in range(160):
        form = rng.choice(["named"] * 4 + ["optional", "list", "array", "map", "tuple", "union", "func", "stream"])
        if rng.random() < 0.2:
            names.append((f"a{k}", "alias", None, None, None, rng.choice([k + 1, rng.randrange(200), rng.randrange(170)])))
        name = rng.choice([n[0] for n in names[:6]] + [f"a{k}" if names[-1][0] == f"a{k}" else "unknown"] * 4)
        refs.append((k, form, name, rng.choice([None, 3])))
        below = [c for c in range(k + 1, 170)]  # structure goes down, only aliases go up
        children += [(k, pos, rng.choice(below)) for pos in range({"named": rng.randrange(3), "map": 2, "tuple": rng.randrange(4), "union": 2, "func": 3}.get(form, rng.choice([1, 1, 1, 2])))]
    check(spark, refs + refs[:3], children + children[:5], names)


def test_deep_terms(spark):
    """A chain of twenty forms, of which the innermost two are bytes."""
    refs = [(k, ("optional", "list")[k % 2], "-", None) for k in range(20)] + [(20, "named", "byte", None), (21, "named", "List", None)]
    of, found = check(spark, refs, [(k, 0, k + 1) for k in range(20)] + [(21, 0, 20)], KNOWN)
    assert found[of[19]].form == found[of[21]].form == "bytes" and found[of[0]].height == 19


def test_no_types(spark):
    of, found = shapes.folded(*(spark.createDataFrame([], s) for s in (REFS, CHILDREN, NAMES)))
    assert of.count() == found.count() == 0
    assert shapes.spelled(found, {}).count() == 0


def test_fields_and_refusals(spark):
    refs = [(1, "optional", "-", None), (2, "named", "long", None), (3, "map", "-", None), (4, "tuple", "-", None), (5, "list", "-", None)]
    of, found = shapes.folded(spark.createDataFrame(refs, REFS), spark.createDataFrame([(1, 0, 2), (3, 0, 2), (3, 1, 5), (5, 0, 4), (4, 0, 2)], CHILDREN), spark.createDataFrame(KNOWN, NAMES))
    fields = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 2, False), ("d", 9, True)], "field string, ref long, present boolean")
    typed, every = shapes.optional_fields(fields, of, found)
    got = {r.field: (r.form, r.height) for r in typed.join(every, "shape").collect()}
    assert got == {"a": ("optional", 1), "b": ("optional", 1), "c": ("scalar", 0)} and every.count() == found.count()
    text = shapes.spelled(found, {"scalar": lambda x: F.concat("class", "bits"), "optional": lambda x: F.concat(x[0], F.lit("?")), "map": lambda x: F.array_join(x, "->"), "list": lambda x: x[0]})
    got = {r.ref: (r.text, r.refusal) for r in of.join(text, "shape").collect()}
    assert got == {1: ("int64?", None), 2: ("int64", None), 3: (None, "a list: a tuple: a tuple has no spelling"), 4: (None, "a tuple has no spelling"), 5: (None, "a tuple: a tuple has no spelling")}


def test_presence_is_settled_for_references(spark):
    """Fields meet a type by its reference, with presence or without; of a field whose presence is null the type stands as it is."""
    refs = [(1, "optional", "-", None), (2, "named", "long", None)]
    of, found = shapes.folded(spark.createDataFrame(refs, REFS), spark.createDataFrame([(1, 0, 2)], CHILDREN), spark.createDataFrame(KNOWN, NAMES))
    got = {(r.ref, r.present): (r.form, r.height, r.wrapped) for r in shapes.presences(of, found).collect()}
    assert got == {(1, False): ("optional", 1, False), (1, True): ("optional", 1, False), (2, False): ("scalar", 0, False), (2, True): ("optional", 1, True)}
    typed, _ = shapes.optional_fields(spark.createDataFrame([("a", 2, None)], "field string, ref long, present boolean"), of, found)
    assert [r.form for r in typed.join(found, "shape").collect()] == ["scalar"]


def test_a_round_of_spelling_reads_what_it_needs(spark, monkeypatch):
    """In a chain a height has one child, so a round reads the shapes and one height below, not all that is spelled so far."""
    refs = [(k, "optional", "-", None) for k in range(8)] + [(8, "named", "long", None)]
    of, found = shapes.folded(spark.createDataFrame(refs, REFS), spark.createDataFrame([(k, 0, k + 1) for k in range(8)], CHILDREN), spark.createDataFrame(KNOWN, NAMES))
    found, write, read = shapes.cut(found), shapes.cut, []

    def counted(df):
        read.append({os.path.dirname(f) for f in df.inputFiles()})
        return write(df)

    monkeypatch.setattr(shapes, "cut", counted)
    text = shapes.spelled(found, {"scalar": lambda x: F.concat("class", "bits"), "optional": lambda x: F.concat(F.lit("*"), x[0])})
    assert max(map(len, read)) <= 2
    assert {r.ref: (r.text, r.refusal) for r in of.join(text, "shape").collect()} == {k: ("*" * (8 - k) + "int64", None) for k in range(9)}
