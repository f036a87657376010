"""Shapes of types: terms of any depth as tables of nodes.

A reference to a type is a row (ref, form, name, length); its children are rows (ref, pos, child). The
fold goes from the leaves up, a level of nesting a round, by joins. A shape is known by a digest of its
form and its children's digests, so equal shapes are one row however often and wherever they occur, and
no term is held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .incremental import cut, discard

#: Forms and the phrases for them (fixed values).
PHRASES = {
    "optional": "an optional", "list": "a list", "array": "an array", "map": "a map", "func": "a function type", "tuple": "a tuple", "union": "a union",
    "intersection": "an intersection", "stream": "a stream", "borrow": "a borrow", "wildcard": "a wildcard", "inline": "an inline type", "scalar": "a scalar", "bool": "a boolean",
    "text": "text", "bytes": "bytes", "reference": "a reference", "sum": "a sum", "opaque": "an unclassified type", "parameter": "a type parameter", "dynamic": "the top type",
}
ONE_CHILD = ("optional", "list", "array", "stream", "borrow")
LEAVES = ("scalar", "bool", "text", "bytes", "dynamic", "opaque", "parameter")
SHAPE = "shape string, form string, class string, bits int, length int, name string, elems array<string>, height int"
_FIELDS = [f.split()[0] for f in SHAPE.split(", ")]


def _shape(form, kind, bits, length, name, elems, height) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (form, kind, bits, length, name)]
    digest = F.sha2(F.concat_ws("\x1f", *parts, F.array_join(elems, ",")), 256)
    return F.struct(*[c.cast(t).alias(n) for c, n, t in zip((digest, form, kind, bits, length, name, elems, height), _FIELDS, [f.split(" ", 1)[1] for f in SHAPE.split(", ")], strict=True)])


def resolved(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs with the form that a named one gets by its name: `builtin` that of the name, `declared` a reference, `sum`, `param` and `alias`; a name that is not known is opaque."""
    known = names.select("name", "kind", F.col("form").alias("_form"), F.col("class").alias("_class"), F.col("bits").alias("_bits"), "target")
    rows, kind = refs.join(known, "name", "left"), F.col("kind")
    by_name = F.when(kind == "builtin", F.col("_form")).when(kind == "declared", "reference").when(kind == "sum", "sum").when(kind == "param", "parameter").when(kind == "alias", "alias").otherwise("opaque")
    form, named = F.when(F.col("form") == "named", by_name).otherwise(F.col("form")), F.col("form") == "named"
    rows = rows.select("ref", form.alias("form"), F.when(named & (kind == "builtin"), F.col("_class")).alias("class"), F.when(named & (kind == "builtin"), F.col("_bits")).alias("bits"), F.when(F.col("form") == "array", F.col("length")).alias("length"), "name", F.when(named & (kind == "alias"), F.col("target")).alias("target"))
    return rows.withColumn("name", F.when(F.col("form").isin("reference", "sum", "opaque", "parameter", "alias"), F.col("name")))


def folded(refs: DataFrame, children: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shape of every reference (ref, shape), and the shapes (shape, form, class, bits, length, name, elems, height), each once.

    refs: ref, form, name, length; form `named` is settled by the name. children: ref, pos, child. names:
    name, kind, form, class, bits, target (the reference that an alias stands for); see resolved. An
    alias has the shape of its target. An array and a stream fold their first child alone, a list of
    unsigned 8-bit scalars is bytes, leaves have no children, and a form that takes another number of
    children than it is given is opaque. An alias that leads into a circle of aliases has no finite
    shape: it is opaque. A child that is no reference counts as missing. Rows that repeat are one; an
    empty table gives no rows.
    """
    known, alias = refs.select("ref").distinct(), F.coalesce(F.col("kind") == "alias", F.lit(False))
    led = names.where(alias).join(known.select(F.col("ref").alias("target"), F.lit(True).alias("there")), "target", "left").withColumn("target", F.when(F.col("there"), F.col("target")))
    nodes = resolved(refs.dropDuplicates(["ref"]), names.where(~alias).unionByName(led.select(*names.columns)))
    given = children.select("ref", F.col("pos").cast("int").alias("pos"), "child").distinct().join(known.select(F.col("ref").alias("child")), "child", "left_semi")
    given = given.groupBy("ref").agg(F.collect_list(F.struct("pos", "child")).alias("given"))
    nodes, form = nodes.join(given, "ref", "left"), F.col("form")
    child = given.schema["given"].dataType.simpleString()
    no_kids, target = F.array().cast(child), F.array(F.struct(F.lit(0).alias("pos"), F.col("target").alias("child"))).cast(child)
    kids = F.when(form == "alias", F.when(F.col("target").isNotNull(), target).otherwise(no_kids)).when(form.isNull() | form.isin(*LEAVES), no_kids)
    kids = kids.when(form.isin("array", "stream"), F.filter("given", lambda x: x["pos"] == 0)).otherwise(F.col("given"))
    nodes = nodes.withColumn("kids", F.coalesce(kids, no_kids)).withColumn("n", F.size("kids")).drop("given", "target")
    wrong = (form.isin(*ONE_CHILD) & (F.col("n") != 1)) | ((form == "map") & (F.col("n") != 2)) | ((form == "alias") & (F.col("n") == 0))
    nodes = cut(nodes.withColumn("name", F.when(wrong, F.coalesce("name", "form")).otherwise(F.col("name"))).withColumn("form", F.when(wrong, "opaque").otherwise(form)))
    none = F.array().cast("array<string>")

    def plain(form, name=None) -> Column:
        null = F.lit(None)
        return _shape(F.lit(form), null, null, null, null if name is None else name, none, F.lit(0))

    own = [F.col(c) for c in ("form", "class", "bits", "length", "name")]
    leaf = F.when(F.col("form") == "opaque", plain("opaque", F.col("name"))).otherwise(_shape(*own, none, F.lit(0)))
    frontier = nodes.where("n = 0 or form = 'opaque'").select("ref", leaf.alias("s"))
    settled = [F.col(f"node.{c}") for c in ("form", "class", "bits", "length", "name")]
    first = F.col("c")[0]["s"]
    byte = (settled[0] == "list") & (first["form"] == "scalar") & (first["class"] == "uint") & (first["bits"] == 8)
    built = _shape(*settled, F.transform("c", lambda x: x["s"]["shape"]), 1 + F.array_max(F.transform("c", lambda x: x["s"]["height"])))
    shape = F.when(settled[0] == "alias", first).when(byte, plain("bytes")).otherwise(built)
    waiting = nodes.where("n > 0 and form <> 'opaque'").select("ref", F.struct(*own).alias("node"), F.inline("kids")).withColumn("s", F.lit(None).cast(f"struct<{SHAPE.replace(' ', ':').replace(',:', ',')}>"))
    circular = F.col("node.form") == "alias"
    parts = [frontier]
    while True:
        met = frontier.select(F.col("ref").alias("child"), F.col("s").alias("_s"))
        # Of what waits only an alias needs the elements of its child, and that is settled at once.
        now = waiting.join(met, "child", "left").withColumn("s", F.coalesce("s", F.when(circular, F.col("_s")).when(F.col("_s").isNotNull(), F.col("_s").withField("elems", none))))
        every, counts = F.every(F.col("s").isNotNull()).alias("ready"), Observation()
        now = now.groupBy("ref").agg(F.first("node").alias("node"), every, F.array_sort(F.collect_list(F.struct("pos", "child", "s"))).alias("c"))
        now = cut(now.observe(counts, F.count_if("ready").alias("fresh"), F.count_if(~F.col("ready")).alias("left"), F.count_if(~F.col("ready") & circular).alias("circular")))
        n_fresh, n_left, n_circular = (counts.get.get(k, 0) for k in ("fresh", "left", "circular"))
        fresh, left = now.where("ready").select("ref", shape.alias("s")), now.where("not ready")
        if n_left and not n_fresh:  # what is left leads into circles
            if not n_circular:
                raise ValueError("children lead back to their own references: terms are finite")
            fresh, left, n_left = left.where(circular).select("ref", plain("opaque", F.col("node.name")).alias("s")), left.where(~circular), n_left - n_circular
        parts.append(fresh)
        if not n_left:
            break
        waiting, frontier = left.select("ref", "node", F.inline("c")), fresh
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select("ref", "s.shape"), found.select("s.*").dropDuplicates(["shape"])


def described(form: Column) -> Column:
    """The phrase for a form."""
    phrases = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    return F.coalesce(F.try_element_at(phrases, form), F.concat(F.lit("the form "), form))


def optional_fields(fields: DataFrame, shape_of: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shapes of fields (ref, present, and more columns) in place of ref, and all shapes: a field with presence is an optional of its type's shape, unless that is an optional or the top type already."""
    types = presences(shape_of, shapes)
    settled = fields.withColumn("present", F.coalesce("present", F.lit(False))).join(types, ["ref", "present"])
    keep = [c for c in fields.columns if c not in ("ref", "present")]
    used = types.where("wrapped").join(fields.where("present").select("ref").distinct(), "ref", "left_semi")
    more = used.select(*[F.col("full")[c].alias(c) for c in _FIELDS]).dropDuplicates(["shape"])
    return settled.select(*keep, "shape"), shapes.unionByName(more).dropDuplicates(["shape"])


def presences(shape_of: DataFrame, shapes: DataFrame) -> DataFrame:
    """Of every reference (ref) without presence and with it (present): shape, form and height, whether that is a new optional (wrapped), and if so all of it (full). What is settled here for a reference is not settled for each field of its type, and fields meet it by their reference, not by a shape that many share."""
    typed = shape_of.join(shapes.select("shape", "form", "height"), "shape")
    outer = _shape(F.lit("optional"), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.array("shape"), F.col("height") + 1)
    both = typed.withColumn("present", F.explode(F.array(F.lit(False), F.lit(True))))
    wraps = F.col("present") & ~F.col("form").isin("optional", "dynamic")
    both = both.select("ref", "present", wraps.alias("wrapped"), F.when(wraps, outer).alias("full"), *[F.col(c).alias(f"_{c}") for c in ("shape", "form", "height")])
    return both.select("ref", "present", "wrapped", "full", *[F.coalesce(F.col("full")[c], f"_{c}").alias(c) for c in ("shape", "form", "height")])


def spelled(shapes: DataFrame, patterns: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """shape, text, refusal: how a language writes every shape. patterns: of each form that it has, a function from the array of the children's texts (and by name, bits, class and length of the shape) to the text.

    A shape is refused where its form has no pattern, or where a child is; the refusal names the children
    on the way to the first, and a shape that is refused has no text. From the leaves up, a height a round:
    a round reads the shapes of its height, and of what is spelled only what this height or a later one has
    as a child.
    """
    tallest = Observation()
    found = cut(shapes.observe(tallest, F.max("height").alias("top")))
    used = found.select("height", F.explode("elems").alias("shape")).groupBy("shape").agg(F.max("height").alias("last"))
    rows = cut(found.join(used, "shape", "left").sortWithinPartitions("height"))
    discard(found)
    text = F.lit(None).cast("string")
    for form, pattern in patterns.items():
        text = F.when(F.col("form") == form, pattern(F.col("texts"))).otherwise(text)
    unknown = F.when(~F.col("form").isin(*patterns), F.concat(described(F.col("form")), F.lit(" has no spelling")))
    node = [c for c in rows.columns if c not in ("elems", "height")]
    levels, height, top = [], 0, tallest.get.get("top")
    while top is not None and height <= top:
        here = rows.where(F.col("height") == height)
        if not levels:
            known = here.withColumn("texts", F.array().cast("array<string>")).withColumn("_refusal", F.lit(None).cast("string"))
        else:
            below = reduce(DataFrame.unionByName, [level for level, last in levels if last >= height]).where(F.col("last") >= height)
            below = below.select(F.col("shape").alias("child"), F.col("form").alias("_form"), F.col("text").alias("_text"), F.col("refusal").alias("_refused"))
            kids = here.select(F.struct(*node).alias("node"), F.posexplode("elems").alias("pos", "child")).join(below, "child")
            sent = F.concat(described(F.col("_form")), F.lit(": "), F.col("_refused"))
            texts = F.array_sort(F.collect_list(F.struct("pos", F.col("_text").alias("t")))).alias("_t")
            kids = kids.groupBy("node.shape").agg(F.first("node").alias("node"), texts, F.min_by(sent, F.when(F.col("_refused").isNotNull(), F.col("pos"))).alias("_refusal"))
            known = kids.select("node.*", F.transform("_t", lambda x: x["t"]).alias("texts"), "_refusal")
        refusal, latest = F.coalesce(unknown, F.col("_refusal")), Observation()
        level = known.select("shape", "form", F.when(refusal.isNull(), text).alias("text"), refusal.alias("refusal"), "last")
        level = cut(level.observe(latest, F.max("last").alias("last")))
        levels.append((level, latest.get.get("last") or 0))
        height += 1
    done = reduce(DataFrame.unionByName, [level for level, _ in levels]) if levels else rows.select("shape", *[F.lit(None).cast("string").alias(c) for c in ("text", "refusal")])
    return done.select("shape", "text", "refusal")
