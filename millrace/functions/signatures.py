"""Callables by their signatures, and values of their types.

A callable is a row of inputs, values, fails, has_ctx, n_params, n_returns, first_form, first_variadic,
value_form, last_form, first_type, value_type, stream, name: the counts without the context and the
error, the forms of the first input, the first value and the last return, and the declared types.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that make a writer a deleter, and a poison accessor a closer.
REMOVAL = ("delete", "remove", "del", "evict", "purge")
RELEASE = ("close", "shutdown", "stop", "disconnect", "terminate")


def shapes() -> dict[str, Column]:
    """The condition of every shape."""
    c = {n: F.col(n) for n in ("inputs", "values", "fails", "has_ctx", "n_params", "n_returns", "first_form", "first_variadic", "value_form", "last_form", "first_type", "value_type", "stream", "name")}
    one, name = c["inputs"] == 1, F.lower(c["name"])
    flag = c["last_form"] == "Bool"
    poison = c["fails"] & (c["n_params"] == 0) & (c["values"] == 0)
    writer = c["fails"] & one & (c["values"] == 0)
    return {
        "Aggregator": (c["inputs"] == 0) & (c["values"] == 1),
        "AnsweringWriter": c["fails"] & one & (c["values"] == 1) & (c["first_type"] != "") & (c["first_type"] == c["value_type"]),
        "BatchReader": c["fails"] & one & c["first_variadic"] & (c["values"] == 1) & c["value_form"].isin("List", "Bytes"),
        "Closer": poison & name.isin(*RELEASE),
        "CompositeWriter": c["fails"] & (c["inputs"] == 2) & (c["values"] == 0),
        "Computation": ~c["has_ctx"] & ~c["fails"] & (c["n_returns"] == 1),
        "Deleter": writer & name.isin(*REMOVAL),
        "Lifecycle": c["has_ctx"] & c["fails"] & (c["inputs"] == 0) & (c["values"] == 0),
        "Lookup": one & (c["n_returns"] == 3) & flag,
        "MultiAggregator": c["fails"] & (c["inputs"] == 0) & (c["values"] >= 2),
        "MultiArgWriter": c["fails"] & (c["inputs"] >= 3) & (c["values"] == 0),
        "MultiReader": c["fails"] & one & (c["values"] >= 2),
        "Mutator": ~c["fails"] & one & (c["n_returns"] == 0),
        "PointerReader": ~c["fails"] & one & (c["n_returns"] == 1) & (c["value_form"] == "Optional"),
        "PoisonAccessor": poison,
        "Predicate": (c["n_params"] == 0) & (c["n_returns"] == 1) & flag,
        "Reader": c["fails"] & one & (c["values"] == 1) & ~c["first_form"].isin("List", "Bytes", "Map", "Func", "Interface"),
        "ReaderNoError": ~c["fails"] & one & ~c["first_variadic"] & (c["n_returns"] == 1) & (c["values"] == 1) & ~c["stream"],
        "ReaderWithBool": one & (c["n_returns"] == 2) & flag,
        "StreamConsumer": c["has_ctx"] & c["fails"] & one & (c["values"] == 1) & (c["first_form"] == "Interface"),
        "StreamReader": (c["inputs"] <= 1) & (c["n_returns"] == 1) & c["stream"],
        "VoidLifecycle": (c["n_params"] == 0) & (c["n_returns"] == 0) & ~c["fails"],
        "Writer": writer,
    }


# The order in which shapes are tried. A shape stands before those that yield to it.
PRECEDENCE = ("BatchReader", "Closer", "CompositeWriter", "Deleter", "Lifecycle", "Lookup", "MultiAggregator", "MultiArgWriter", "MultiReader", "Mutator", "PoisonAccessor", "Predicate", "ReaderWithBool", "StreamConsumer", "AnsweringWriter", "Reader", "StreamReader", "Computation", "Aggregator", "PointerReader", "ReaderNoError", "VoidLifecycle", "Writer")


def shape() -> Column:
    """The first shape, in the order of precedence, whose condition holds; null for none. One pass of conditions inside generated code."""
    known = shapes()
    return F.coalesce(*[F.when(known[n], n) for n in PRECEDENCE])


def zero_value(form: Column) -> Column:
    """The zero literal of a form; null where there is none."""
    return F.when(form == "Scalar", "0").when(form == "Bool", "false").when(form == "Text", '""').when(form.isin("Optional", "List", "Map", "Func", "Bytes", "Interface"), "nil")


def sample_pair(form: Column, hint: Column) -> Column:
    """Two distinct literals of a form; null for a form that has none."""
    pair = lambda a, b: F.struct(a.alias("sample"), b.alias("alternate"))
    quoted = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    return F.when(form == "Bool", pair(F.lit("true"), F.lit("false"))).when(form == "Scalar", pair(F.lit("1"), F.lit("2"))).when(form == "Text", pair(quoted(hint), quoted(F.concat(hint, F.lit("2")))))


def completed(sample: Column, alternate: Column, derived: Column, derived_alternate: Column) -> Column:
    """Authored halves before derived ones, kept distinct: an alternate that equals the sample gives way to the other derived half."""
    first = F.coalesce(sample, F.when(~derived.eqNullSafe(alternate), derived), derived_alternate)
    second = F.coalesce(alternate, F.when(~derived_alternate.eqNullSafe(first), derived_alternate), F.when(~derived.eqNullSafe(first), derived))
    return F.struct(first.alias("sample"), second.alias("alternate"))


def tag_value(tag: Column, key: str) -> Column:
    """The value of `key:"value"` in a struct tag; null without it."""
    pattern = rf'(?:^|\s){key}:"((?:[^"\\]|\\.)*)"'
    return F.when(tag.rlike(pattern), F.regexp_extract(tag, pattern, 1))


def sentinel_name(base: Column) -> Column:
    return F.concat(F.lit("Err"), base)


def mentioned(params: Column, names: Column) -> Column:
    """Type parameters, in their order, that the names mention."""
    return F.filter(params, lambda p: F.array_contains(names, p))


def substituted(spelling: Column, bindings: Column) -> Column:
    """A spelled type with its parameters replaced as the map of bindings says; other words stay."""
    tokens = F.regexp_extract_all(spelling, F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(bindings, t), t)), "")


def overload_key(params: Column) -> Column:
    """The discriminator of an overload: its parameters' spelled types."""
    return F.array_join(F.transform(params, lambda p: F.regexp_replace(p, r"\s+", "")), ",")
