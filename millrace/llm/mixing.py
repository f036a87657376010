"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule, a density over training time. The weights fix how many
words a source supplies; the integral of the schedule says how much of that has been used by any
time. Its inverse turns a document's place in the cumulative demand of its source into a training
position, and the corpus is range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import materialize, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
MIN_BITS = 10  # of the buckets of a source, and their rows at most, about, of a source that is the whole table
CELL_ROWS = 20_000
DIGITS = 15  # of an MD5, in hexadecimal: what fits a long


def _targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Per source (one row each): weight, target by capped shares, whole words to take.

    A source is capped at max_repeats times its size if its share of what is left would exceed that;
    the rest is shared by weight. In ascending order of cap over weight one pass decides it.
    """
    by_name, by_cap = Window.orderBy("skey"), Window.orderBy("ratio", "skey")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    every = Window.partitionBy(F.lit(1))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("weight", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("capped", F.col("left") * F.col("w") >= F.col("cap") * F.col("weight"))
    t = t.withColumn("pool", F.max(F.when(~F.col("capped"), F.col("left"))).over(every)).withColumn("rest", F.max(F.when(~F.col("capped"), F.col("weight"))).over(every))
    share = F.expr("w * pool")
    return t.select(
        "skey", "w", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share / F.col("rest")).alias("target"),
        F.when(F.col("capped"), F.col("cap")).otherwise(F.expr("(2 * w * pool + rest) div (2 * rest)")).alias("take"),
    )


def _inverse(share: Column, tilt: Column) -> Column:
    """Time at which a source with density 1 + tilt * (2t - 1) has used this share of its words."""
    b = 1 - tilt
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / (b + F.sqrt(b * b + 4 * tilt * share)))


def row_key(docs: DataFrame) -> Column:
    """A hash of all of a row's values: rows that share it are equal."""
    plain = lambda n, t: F.to_json(F.struct(docs[f"`{n}`"])) if "map<" in t or "variant" in t else docs[f"`{n}`"]
    return F.xxhash64(*[plain(n, t) for n, t in docs.dtypes])


def _plan(docs: DataFrame, weights: Sequence[int], tilts: Sequence[float], max_repeats: int, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    skey = F.when(docs["source"].isNull(), "1").otherwise(F.concat(F.lit("0"), docs["source"].cast("string")))
    name = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, DIGITS), 16, 10).cast("long")
    slim = materialize(docs.select(docs["doc_id"], size.alias("size"), skey.alias("skey"), h.alias("h"), row_key(docs).alias("key")), "mix")
    bits = max(MIN_BITS, (slim.count() // CELL_ROWS).bit_length())
    slim = slim.withColumn("bucket", F.shiftright("h", 4 * DIGITS - bits).cast("int"))
    cells = slim.groupBy("skey", "bucket").agg(F.sum("size").alias("cell"))
    targets = _targets(slim.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, max_repeats)
    along = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("cell").over(along), F.lit(0))).drop("cell").join(targets, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cells, ["skey", "bucket"])
    before = F.col("before") + F.col("base")
    passes = F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("take") - passes * F.col("source_size") - before))
    copies = F.when(F.col("size") > 0, passes + F.when(rest > 0, 1).otherwise(0)).otherwise(F.lit(0))
    tilt = F.element_at(F.create_map(*[F.lit(x) for pair in zip(weights, tilts, strict=True) for x in pair]), F.col("w").cast("int"))
    position = F.when(copies > 0, _inverse(before / F.col("take"), tilt))
    return placed.select("doc_id", "key", "size", "source_size", "target", (F.col("size") * passes + rest).alias("taken"), copies.cast("int").alias("copies"), position.alias("position"), before.alias("offset"), F.col("take").alias("source_taken"), tilt.alias("tilt"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), tilts: Sequence[float] = (-0.5, 0.0, 0.5), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, position.

    size: words of the text (null: 0). weights and tilts repeat over the sources in code point order,
    null last. A source's documents stand in an order that seed and doc_id fix (the text, if the id is
    null); it is gone through as often as target / source_size says, and in the last pass only as far
    as words are wanted, so the last document may be taken in part. position: training time in 0 to 1
    of the first copy, null if none is taken. Equal rows share what their places get. An empty table
    gives no rows.
    """
    return _plan(docs, weights, tilts, max_repeats, seed).drop("key")


def training_order(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), tilts: Sequence[float] = (-0.5, 0.0, 0.5), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """docs as they are trained on: each as often as mix() takes it, range-sorted by position.

    Places belong to rows, not to ids: rows with a null id, and unlike rows of one id, come as often
    as their own places say; equal rows together as often as all their places say. Documents of which
    no word is taken are left out; one of which a part is taken stays whole.
    """
    plan = _plan(docs, weights, tilts, max_repeats, seed).where("copies > 0")
    copies = plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = (F.col("pass") * F.col("source_size") + F.col("offset")) / F.col("source_taken")
    places = copies.select(F.col("key").alias("_mr_key"), F.col("doc_id").alias("_mr_id"), F.col("pass").alias("_mr_pass"), _inverse(share, F.col("tilt")).alias("_mr_position"))
    rows = docs.withColumn("_mr_key", row_key(docs)).withColumn("_mr_id", docs["doc_id"]).dropDuplicates(["_mr_key", "_mr_id"])
    same = (rows["_mr_key"] == places["_mr_key"]) & rows["_mr_id"].eqNullSafe(places["_mr_id"])
    out = rows.join(places, same).select(*[rows[f"`{c}`"] for c in docs.columns], places["_mr_pass"], places["_mr_position"])
    return out.repartitionByRange(shuffle_partitions(docs.sparkSession), "_mr_position", "doc_id", "_mr_pass").sortWithinPartitions("_mr_position", "doc_id", "_mr_pass").drop("_mr_pass", "_mr_position")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = {
    "op5_mixing": r"""
with d as (select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, case when source is null then '1' else '0' || source end as skey,
    cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))), 1, 15) as bigint) as h from documents),
s as (select skey, cast(sum(size) as bigint) as source_size, [5, 2, 1][(row_number() over (order by skey) - 1) % 3 + 1] as w from d group by skey),
t as (select *, 3 * source_size as cap, sum(source_size) over () - coalesce(sum(3 * source_size) over o, 0) as left_, sum(w) over () - coalesce(sum(w) over o, 0) as weight
    from s window o as (order by 3 * source_size / w, skey rows between unbounded preceding and 1 preceding)),
c as (select *, left_ * w >= cap * weight as capped from t),
p as (select *, max(case when not capped then left_ end) over () as pool, max(case when not capped then weight end) over () as rest from c),
g as (select skey, source_size, cast(w as int) as w, case when capped then cast(cap as double) else cast(w * pool as double) / cast(rest as double) end as target,
    cast(case when capped then cap else (2 * w * pool + rest) // (2 * rest) end as bigint) as take, [-0.5::double, 0::double, 0.5::double][case w when 5 then 1 when 2 then 2 else 3 end] as tilt from p),
b as (select d.*, g.* exclude (skey), cast(coalesce(sum(size) over (partition by d.skey order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as before_ from d join g using (skey)),
q as (select *, case when source_size > 0 then take // source_size else 0 end as passes from b),
r as (select *, greatest(0, least(size, take - passes * source_size - before_)) as part from q),
k as (select *, case when size > 0 then passes + case when part > 0 then 1 else 0 end else 0 end as n, cast(before_ as double) / cast(take as double) as y from r)
select doc_id, size, source_size, target, cast(size * passes + part as bigint) as taken, cast(n as int) as copies,
  case when n > 0 then case when y <= 0 then 0::double else 2 * y / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y)) end end as position from k"""
}
