"""Scalar functions by example, and against slow definitions."""

from __future__ import annotations

import re
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import directives, identity, naming, text


@pytest.mark.parametrize(
    ("name", "words"),
    [("helloWorld", "hello World"), ("HTTPServer", "HTTP Server"), ("Int64Value", "Int64 Value"), ("UserIDs", "User IDs"), ("URLsToFetch", "URLs To Fetch"), ("IDsort", "I Dsort"), ("a_b-c.d/e f\tg", "a b c d e f g"), ("Version2", "Version2"), ("", ""), ("__", "")],
)
def test_words(name, words):
    assert naming.words(name) == words.split()


def test_cases():
    c = naming.Caser()
    assert [c.pascal(x) for x in ("user_ids", "IOReader", "ListPDFs", "STATUS_ACTIVE", "http_url", "")] == ["UserIDs", "IOReader", "ListPDFs", "STATUS_ACTIVE", "HTTPURL", ""]
    assert [c.camel(x) for x in ("STATUS_ACTIVE", "IDsToFetch", "URLPath", "HTTPServer")] == ["statusActive", "idsToFetch", "urlPath", "httpServer"]
    assert naming.snake("UserIDs") == "user_ids" and naming.kebab("HTTPServer") == "http-server" and naming.screaming_snake("aB") == "A_B"
    assert naming.Caser(more=["pdf"]).pascal("list_pdf") == "ListPDF"


@settings(max_examples=200)
@given(st.text("abAB_1", max_size=12))
def test_snake_is_idempotent(name):
    once = naming.snake(name)
    assert naming.snake(once) == once


def test_distance():
    assert naming.osa("abcd", "acbd") == 1 and naming.osa("", "ab") == 2 and naming.osa("ca", "abc") == 3


@settings(max_examples=200)
@given(st.text("ab c\n\t", max_size=60), st.integers(0, 9))
def test_wrap(body, width):
    lines = text.wrap(body, width)
    assert " ".join(lines).split() == body.split()
    if width:
        assert all(len(x) <= width or " " not in x for x in lines)


def test_a_batch_of_texts_is_wrapped_in_little_memory(spark):
    bodies = ["some words of a text " * 500, None, ""] * 300
    texts = pa.array(bodies)
    tracemalloc.start()
    found = text.wrap_batch(texts, 72, text.MARKDOWN)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [None if t is None else text.wrap(t, 72, text.MARKDOWN) for t in bodies]
    assert peak < 3 << 20  # the lines of all are 5 MB and more as Python strings
    df = spark.createDataFrame([(t,) for t in bodies[:3]], "t string").select(text.wrapped(F.col("t"), 72).alias("w"))
    assert [r.w for r in df.collect()] == [None if t is None else text.wrap(t, 72) for t in bodies[:3]]


def test_wrap_keeps_blocks_down():
    assert text.wrap("aaa - bbb", 3, text.MARKDOWN) == ["aaa -", "bbb"]
    assert text.wrap("a\n\n \nb", 10) == ["a", "", "b"]


@pytest.mark.parametrize(("value", "spelled"), [(1e21, "1e+21"), (1e20, "1" + "0" * 20), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (0.1, "0.1"), (0.0, "0"), (-2.5, "-2.5"), (1e-10, "1e-10")])
def test_decimal_spelling(value, spelled):
    assert text.decimal_spelling(value) == spelled


def test_directive_grammar():
    name, args = directives.parse('p:n a k=v q="x \\"y\\"" l=[a, "b c"]')
    assert name == "p:n" and args == [("", ("a", False), 4), ("k", ("v", False), 6), ("q", ('x "y"', True), 10), ("l", [("a", False), ("b c", True)], 22)]
    for bad in ("", "1a", "a b=", 'a "x', "a [x", 'a "\\q"', "a =b", "a:1"):
        with pytest.raises(directives.Refused):
            directives.parse(bad)
    assert directives.cut("a [x y] +b c", lambda r: r.startswith("+")) == ("a [x y]", "+b c", True)
    assert directives.cut('a "x +b"', lambda r: r.startswith("+")) == ('a "x +b"', "", False)


@settings(max_examples=300)
@given(st.text('ab1:= "[],\\n\t', max_size=20))
def test_parse_never_breaks(payload):
    try:
        directives.parse(payload)
    except directives.Refused as e:
        assert 0 <= e.at <= len(payload)


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize("spelled", ["go:a/b", "go:a/b.Name", "go:a.b/c.Owner#Name", "go:a.F(int,text)", "go:a.T#M()"])
def test_identity_round_trip(spark, spelled):
    p = one(spark, identity.parsed(F.lit(spelled)))
    again = identity.spelled(*[F.lit(p[k]) for k in ("lang", "package", "owner", "name", "kind", "disc")])
    assert one(spark, again) == spelled


@pytest.mark.parametrize("bad", ["", "go", "go:", ":a", "go:a.", "go:a(", "go:a.f(x", "go:#m", "go:a#m"])
def test_no_identity(spark, bad):
    assert one(spark, identity.parsed(F.lit(bad))) is None


def test_flat_name(spark):
    assert one(spark, identity.flat_name(F.lit("Session.middle"), F.lit("inner"))) == "SessionMiddleInner"
    assert one(spark, identity.flat_name(F.lit(""), F.lit("x"))) == "x"


def test_comments_and_trailers(spark):
    assert one(spark, text.block_comment(F.lit("a */\r\nb"), "/**", " * ", " */")) == "/**\n * a *\\/\n * b\n */\n"
    assert one(spark, text.inline_comment(F.lit("a\r\nb /* c */"))) == " /* a b /\\* c *\\/ */"
    assert one(spark, text.normalised(F.lit("\n\na  \n\n\n\nb\t"))) == "a\n\nb\n"
    assert one(spark, text.joined(F.array(F.lit("a \\"), F.lit("  b")))) == "a b"
    good = text.stamped(F.lit("body"), "// sum ")
    assert one(spark, text.verified(good, "// sum ")) is True
    assert one(spark, text.verified(F.replace(good, F.lit("body"), F.lit("bode")), "// sum ")) is False


@pytest.mark.parametrize(("lines", "offset", "at"), [(["ab \\", "  cd"], 0, (0, 0)), (["ab \\", "  cd"], 3, (1, 2)), (["ab \\", "  cd"], 9, (1, 4)), ([], 0, (0, 0))])
def test_located(lines, offset, at):
    assert text.located(lines, offset) == at


@pytest.mark.parametrize(("base", "over", "found"), [("a/b", "c.go", ("a/b", "c.go")), ("a/b", "../c/", ("a/c", "")), ("a", "../../x", None), ("a", "/x", None), ("a", "x\\y", None), ("a", "..", (".", ""))])
def test_redirect(base, over, found):
    assert text.redirect(base, over) == found


@pytest.mark.parametrize(("pattern", "path", "hit"), [("**/*.go", "a.go", True), ("**/*.go", "x/y/a.go", True), ("*.go", "x/a.go", False), ("a/**", "a/b/c", True), ("a/**/z", "a/z", True), ("[ab]?", "ax", True), ("a", "b", False)])
def test_globs(pattern, path, hit):
    assert bool(re.match(text.glob_pattern(pattern).replace(r"\z", r"\Z"), path)) is hit


def test_near_equals_its_rule(spark):
    """Of names over few letters, of one byte and of more, the filter before the distance loses none."""
    import random

    rng = random.Random(6)
    names = ["".join(rng.choice("abé日") for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    pairs = [(a, rng.choice([b, a[:3] + b[:1] + a[3:], a[1::-1] + a[2:], a[:-1]])) for a in names for b in rng.sample(names, 4)] + [(None, "a"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", naming.near(F.col("a"), F.col("b")).alias("n")).collect()

    def want(a, b):
        if a is None or b is None:
            return None
        longer, d = max(len(a.encode()), len(b.encode())), naming.osa(a, b)
        return d <= 2 and 3 * d <= longer

    assert [r.n for r in got] == [want(r.a, r.b) for r in got] and sum(bool(r.n) for r in got) > 50
