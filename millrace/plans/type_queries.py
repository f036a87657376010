"""Shapes of nested types over a tree of parts, as deep as the logarithm of their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes
from .registry import query

#: The same references, children and names as _types, and each with the tokens of its shape in order.
TYPES = """
m as (select max(p_partkey) as top from part),
n as (select p_partkey as ref, 2 * p_partkey > top as leaf, p_size as length, case when 2 * p_partkey > top then 'named' when 2 * p_partkey + 1 > top then 'optional' else ['list', 'map', 'tuple', 'array', 'named'][p_size % 5 + 1] end as form,
  case when 2 * p_partkey <= top then 'Pair' else ['byte', 'long', 'bool', 'text', p_brand, 'T', 'a' || p_partkey, 'double', 'x' || p_brand][p_partkey % 9 + 1] end as name,
  case when 2 * p_partkey > top and p_partkey % 9 = 6 then case when p_partkey % 2 = 0 then p_partkey - 6 else p_partkey // 4 end end as target from part, m where p_partkey > 0),
c as (select ref, 0 as pos, 2 * ref as child from n where not leaf union all select ref, 1, 2 * ref + 1 from n where not leaf and form in ('map', 'tuple', 'named')),
g as (select ref as a, child as b from c union all select ref, target from n where target is not null),
o(start, node) as (select a, b from g join n on ref = a where target is not null union select start, b from o join g on a = node),
ill as (select distinct start as ref from o where node in (select start from o where start = node)),
bytes_ as (select c.ref from c join n using (ref) join n k on k.ref = child left join n x on x.ref = k.target where n.form = 'list' and (k.leaf and k.name = 'byte' or k.ref not in (select ref from ill) and x.leaf and x.name = 'byte')),
k as (select n.*, ref in (select ref from ill) as ill, ref in (select ref from bytes_) as byte from n),
w(root, node, path, phrases) as (select ref, ref, [0::double], []::varchar[] from k
  union all select root, coalesce(c.child, k.target), list_append(path, coalesce(c.pos, 0)), case when k.target is null then list_append(phrases, '') else list_append(phrases, 'skip') end
  from w join k on k.ref = node left join c on c.ref = node where not byte and not ill and (c.child is not null or k.target is not null)),
s as (select root, path, phrases, k.*, case when ill then 'opaque' when byte then 'bytes' when form <> 'named' then form when not leaf then 'reference' when name in ('byte', 'long', 'double') then 'scalar' when name in ('bool', 'text') then name
  when name = 'T' then 'parameter' when name[1] = 'x' then 'opaque' else 'reference' end as kind from w join k on k.ref = node where target is null or ill),
tokens as (select root, path, phrases, ref, kind, length, name, kind || case when kind = 'array' then length::varchar when kind in ('scalar', 'opaque', 'reference', 'parameter') then ':' || name else '' end as token,
  len(path) - len(list_filter(phrases, lambda p: p = 'skip')) as depth from s),
shaped as (select root as ref, string_agg(token, ' ' order by path) as text, max(depth) - 1 as height, arg_min(kind, path) as form from tokens group by root)"""


def _types(t):
    top = t.part.agg(F.max("p_partkey").alias("top"))
    key = F.col("p_partkey")
    p = t.part.where(key > 0).crossJoin(F.broadcast(top)).withColumn("leaf", 2 * key > F.col("top"))  # top is one row
    form = F.when(F.col("leaf"), "named").when(2 * key + 1 > F.col("top"), "optional").otherwise(F.array(*map(F.lit, ("list", "map", "tuple", "array", "named")))[(F.col("p_size") % 5).cast("int")])
    leaf_name = F.array(*map(F.lit, ("byte", "long", "bool", "text")), F.col("p_brand"), F.lit("T"), F.concat(F.lit("a"), key), F.lit("double"), F.concat(F.lit("x"), "p_brand"))[(key % 9).cast("int")]
    p = p.select(key.alias("ref"), "leaf", form.alias("form"), F.when(F.col("leaf"), leaf_name).otherwise("Pair").alias("name"), F.col("p_size").alias("length"))
    inner = p.where("not leaf")
    both = F.when(F.col("form").isin("map", "tuple", "named"), F.array(2 * F.col("ref"), 2 * F.col("ref") + 1)).otherwise(F.array(2 * F.col("ref")))
    children = inner.select("ref", F.posexplode(both).alias("pos", "child"))
    alias = p.where("leaf and ref % 9 = 6").select("name", F.lit("alias").alias("kind"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("int").alias("bits"), F.when(F.col("ref") % 2 == 0, F.col("ref") - 6).otherwise(F.floor(F.col("ref") / 4)).alias("target"))
    fixed = [("byte", "builtin", "scalar", "uint", 8), ("long", "builtin", "scalar", "int", 64), ("double", "builtin", "scalar", "float", 64), ("bool", "builtin", "bool", None, None), ("text", "builtin", "text", None, None), ("T", "param", None, None, None), ("Pair", "declared", None, None, None)]
    known = t.spark.createDataFrame([(*f, None) for f in fixed], "name string, kind string, form string, class string, bits int, target long")
    brands = t.part.select(F.col("p_brand").alias("name")).distinct().select("name", F.lit("declared").alias("kind"), *[F.lit(None).cast(k).alias(c) for c, k in (("form", "string"), ("class", "string"), ("bits", "int"), ("target", "long"))])
    return p.select("ref", "form", "name", "length"), children, known.unionByName(brands).unionByName(alias)


@query(f"with recursive {TYPES} select ref, form, cast(height as int) as height, min(ref) over (partition by text) as first from shaped")
def type_shapes(t):
    """The shape of every reference, known by the first reference of that shape."""
    of, found = shapes.folded(*_types(t))
    first = of.groupBy("shape").agg(F.min("ref").alias("first"))
    return of.join(found.select("shape", "form", "height"), "shape").join(first, "shape").select("ref", "form", "height", "first")


@query(f"with recursive {TYPES} select form, cast(count(*) as bigint) as references_, cast(count(distinct text) as bigint) as shapes, cast(max(height) as int) as height from shaped group by form")
def shape_counts(t):
    """Of each form, how many references share how many shapes."""
    of, found = shapes.folded(*_types(t))
    return of.join(found, "shape").groupBy("form").agg(F.count("*").alias("references_"), F.countDistinct("shape").alias("shapes"), F.max("height").alias("height"))


@query(f"""with recursive {TYPES} select l_orderkey, l_linenumber, l_suppkey, case when l_returnflag = 'R' and form <> 'optional' then 'optional' else form end as form,
  cast(case when l_returnflag = 'R' and form <> 'optional' then 1 else 0 end + height as int) as height from lineitem join shaped on ref = l_partkey""")
def field_shapes(t):
    """Fields of the lines' part types; those of returned lines have presence."""
    of, found = shapes.folded(*_types(t))
    fields = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("ref"), F.coalesce(F.col("l_returnflag") == "R", F.lit(False)).alias("present"))
    types = shapes.presences(of, found).select("ref", "present", "form", "height")
    return fields.join(types, ["ref", "present"]).select("l_orderkey", "l_linenumber", "l_suppkey", "form", "height")


@query(f"""with recursive {TYPES},
z as (select root, path, case kind when 'list' then '[]' when 'array' then '[' || length || ']' when 'optional' then '*' when 'map' then 'map[' when 'bool' then 'bool' when 'text' then 'string' when 'bytes' then '[]byte' when 'scalar' then case name when 'byte' then 'uint8' when 'long' then 'int64' else 'float64' end
  when 'reference' then case when name = 'Pair' then 'Pair[' else name end when 'parameter' then name end as token, kind from tokens
  union all select root, list_append(path, 0.5), case when kind = 'map' then ']' else ', ' end, kind from tokens where kind = 'map' or name = 'Pair' and kind = 'reference'
  union all select root, list_append(path, 2), ']', kind from tokens where name = 'Pair' and kind = 'reference'),
bad as (select root, min(path) as path from tokens where kind in ('tuple', 'opaque') group by root),
phrase as (select *, case kind when 'optional' then 'an optional' when 'array' then 'an array' when 'tuple' then 'a tuple' when 'opaque' then 'an unclassified type' when 'reference' then 'a reference' else 'a ' || kind end as p from tokens),
refused as (select b.root, coalesce(string_agg(p || ': ', '' order by x.path) filter (where x.path <> y.first), '') || arg_max(p, x.path) || ' has no spelling' as refusal
  from bad b join phrase x on x.root = b.root and x.path = b.path[:len(x.path)] join (select root, min(path) as first from tokens group by root) y on y.root = b.root group by b.root)
select s.ref, refusal, case when refusal is null then string_agg(token, '' order by z.path) end as text from shaped s join z on z.root = s.ref left join refused r on r.root = s.ref group by s.ref, refusal""")
def spelled_types(t):
    """Every type as a language writes it that has no tuples; a refusal names the way to the first."""
    of, found = shapes.folded(*_types(t))

    def args(x):
        return F.when(F.size(x) > 0, F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))).otherwise("")

    patterns = {
        "list": lambda x: F.concat(F.lit("[]"), x[0]), "array": lambda x: F.concat(F.lit("["), F.col("length"), F.lit("]"), x[0]), "optional": lambda x: F.concat(F.lit("*"), x[0]),
        "map": lambda x: F.concat(F.lit("map["), x[0], F.lit("]"), x[1]), "bool": lambda x: F.lit("bool"), "text": lambda x: F.lit("string"), "bytes": lambda x: F.lit("[]byte"),
        "scalar": lambda x: F.concat("class", "bits"), "reference": lambda x: F.concat(F.col("name"), args(x)), "parameter": lambda x: F.col("name"),
    }
    return of.join(shapes.spelled(found, patterns), "shape").select("ref", "refusal", "text")
