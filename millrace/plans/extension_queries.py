"""Extension points, sinks and the rest of the surface over the tables."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from ..functions import directives, naming, signatures, text
from ..operators import emitting, gates, grouping, linking
from ..sources import frontend, state, trees
from ..streaming import watch
from .function_queries import _folder
from .registry import query
from .scan_queries import PATH, _paths


@query()
def tree_listing(t):
    """The files of the folder itself, by name and size."""
    return trees.listing(t.spark, t.folder).select(F.substring_index("path", "/", -1).alias("name"), "size")


@query("select page_id, page_id % 3 = 0 as output from pages")
def judged_files(t):
    body = F.when(F.col("page_id") % 3 == 0, text.stamped(F.col("html"), "// sum ")).otherwise(F.col("html"))
    return trees.judged(t.pages.select("page_id", body.alias("body")), "body", "// sum ").select("page_id", "output")


@query("select doc_id, cast(len(string_split(text, chr(10))) as bigint) as lines from documents")
def parsed_units(t):
    def parse(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "lines": f["text"].str.count("\n") + 1})

    return trees.parsed(t.documents.select("doc_id", "text"), parse, "doc_id long, lines long")


@query("select p_partkey, p_name, p_brand from part where p_type = 'ECONOMY'")
def sealed_kind_scan(t):
    """Regions written by kind; the scan opens the folder of one."""
    folder = _folder(t)
    trees.write_regions(t.part, folder, ["p_type"])
    return gates.by_kind(trees.sealed(t.spark, folder).withColumnRenamed("p_type", "kind"), "ECONOMY").select("p_partkey", "p_name", "p_brand")


@query("select c_custkey as key, c_mktsegment as value from customer where c_custkey = 42")
def state_point_get(t):
    store = state.Store(t.spark, _folder(t))
    store.commit({"segments": t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(False).alias("dead"))})
    return store.get("segments", 42).select("key", "value")


@query(f"with p as (select page_id, regexp_replace({PATH}, '/[^/]*$', '') as dir from pages) select page_id from p where dir = 'blog.tionsh.example.net/en' or dir like 'm.%' and (dir = 'm.theres.example.org' or starts_with(dir, 'm.theres.example.org/'))")
def narrowed_patterns(t):
    d = _paths(t).select("page_id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    return d.where(gates.in_directory(F.col("dir"), "blog.tionsh.example.net/en") | gates.in_directory(F.col("dir"), "m.theres.example.org/...")).select("page_id")


@query("with s as (select distinct event_type as bare, case when event_type in ('view', 'click') then 'ui' else 'core' end as plugin from events union all select 'view', 'core'), n as (select event_id, case when event_id % 2 = 0 then case when event_type in ('view', 'click') then 'ui:' else 'core:' end || event_type else event_type end as name from events) select n.event_id, count(*) as candidates, count(*) > 1 as ambiguous from n join s on n.name = s.bare or n.name = s.plugin || ':' || s.bare group by 1")
def directive_names(t):
    """A name resolves by its prefixed spelling, or by the bare one where a single plugin has it."""
    plugin = F.when(F.col("event_type").isin("view", "click"), "ui").otherwise("core")
    schemas = t.events.select(F.col("event_type").alias("bare"), plugin.alias("plugin")).distinct().union(t.spark.createDataFrame([("view", "core")], "bare string, plugin string"))
    spellings = schemas.select(F.explode(F.array("bare", F.concat("plugin", F.lit(":"), "bare"))).alias("name"))
    names = t.events.select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(plugin, F.lit(":"), "event_type")).otherwise(F.col("event_type")).alias("name"))
    return names.join(spellings, "name").groupBy("event_id").agg(F.count("*").alias("candidates")).withColumn("ambiguous", F.col("candidates") > 1)


@query("select event_id, case event_id % 3 when 0 then cast(user_id as varchar) end as s, case event_id % 3 when 1 then user_id end as i, case event_id % 3 when 2 then user_id % 2 = 0 end as b from events")
def fact_values(t):
    """One spelling read as the type that its key has; a spelling outside the type reads null."""
    kind, u = F.col("event_id") % 3, F.col("user_id")
    spelled = F.when(kind == 2, F.when(u % 2 == 0, "true").otherwise("false")).otherwise(u.cast("string"))
    return t.events.select("event_id", F.when(kind == 0, spelled).alias("s"), F.when(kind == 1, text.integer_literal(spelled, "int", 64).cast("long")).alias("i"), F.when(kind == 2, text.boolean_literal(spelled)).alias("b"))


@query("select p_partkey as id, p_partkey % 4 as pos, case when p_size % 3 = 0 or k > 1 then 'p' || (p_partkey % 4) else p_name end as settled from (select *, row_number() over (partition by p_partkey // 4, case when p_size % 3 = 0 then '' else p_name end order by p_partkey % 4) as k from part) x")
def unique_params(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 4).alias("fn"), (F.col("p_partkey") % 4).alias("pos"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("name"))
    return emitting.unique_params(rows, ["fn"]).select("id", "pos", "settled")


@query("select l_orderkey, string_agg(l_returnflag || l_linestatus, ',' order by l_linenumber, l_partkey, l_suppkey) as signature from lineitem group by 1")
def signature_keys(t):
    rows = t.lineitem.withColumn("type", F.concat("l_returnflag", "l_linestatus"))
    return grouping.accumulated(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "type", "signature")


@query()
def schema_json(t):
    """The schemas of the tables, as JSON."""
    rows = [(n, getattr(t, n).schema.json()) for n in ("customer", "documents", "events", "lineitem")]
    return t.spark.createDataFrame(rows, "name string, schema string")


@query("select p_partkey, case p_type when 'ECONOMY' then 'int64' when 'STANDARD' then 'string' else 'bool' end as spelling from part where p_type in ('ECONOMY', 'STANDARD', 'PROMO')")
def emit_translate(t):
    mapping = t.spark.createDataFrame([("ECONOMY", "int64"), ("STANDARD", "string"), ("PROMO", "bool")], "p_type string, spelling string")
    return emitting.translated(t.part, mapping, ["p_type"])[0].select("p_partkey", "spelling")


@query("select p_partkey from part where p_type not in ('ECONOMY', 'STANDARD', 'PROMO')")
def emit_refused(t):
    mapping = t.spark.createDataFrame([("ECONOMY", "int64"), ("STANDARD", "string"), ("PROMO", "bool")], "p_type string, spelling string")
    return emitting.translated(t.part, mapping, ["p_type"])[1].select("p_partkey")


@query("select p_partkey, 'mirror' || p_brand as host, true as mirrored from part")
def mirrored_methods(t):
    return emitting.mirrored(t.part, F.concat(F.lit("mirror"), "p_brand")).select("p_partkey", "host", "mirrored")


@query("select p_partkey, case p_type when 'ECONOMY' then 'int' when 'PROMO' then 'float' else 'string' end as witness from part")
def type_witnesses(t):
    c = t.spark.createDataFrame([("ECONOMY", "int"), ("PROMO", "float")], "constraint string, witness string")
    return emitting.witnessed(t.part.withColumnRenamed("p_type", "constraint"), c).select("p_partkey", "witness")


@query("select o_custkey from orders group by o_custkey having count(distinct case when o_orderstatus in ('F', 'O') then o_orderstatus end) = 2")
def error_contract(t):
    """Types that have the members an error needs."""
    m = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("member"))
    return linking.satisfying(m, t.spark.createDataFrame([("F",), ("O",)], "member string")).select(F.col("owner").alias("o_custkey"))


@query("select l_suppkey, l_orderkey, l_partkey, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as int) as at from lineitem")
def slot_appends(t):
    return emitting.appended(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber"], "l_partkey").select("l_suppkey", "l_orderkey", "l_partkey", "at")


@query("select p_brand, 'package ' || p_brand || chr(10) || string_agg('type ' || p_partkey, chr(10) order by p_partkey) as body from part group by p_brand")
def rendered_files(t):
    def render(rows):
        return f"package {rows[0]['p_brand']}\n" + "\n".join(f"type {r['p_partkey']}" for r in rows)

    return emitting.rendered(t.part.select("p_brand", "p_partkey"), "p_brand", render, ["p_partkey"])


@query("select p_brand, max(p_size) - min(p_size) as spread, count(*) as n from part group by p_brand")
def package_handler(t):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_brand": [rows["p_brand"].iloc[0]], "spread": [int(rows["p_size"].max() - rows["p_size"].min())], "n": [len(rows)]})

    return emitting.per_group(t.part.select("p_brand", "p_size"), ["p_brand"], one, "p_brand string, spread int, n long")


@query("select o_orderkey as id, o_orderstatus as kind, case when o_orderstatus = 'F' then 'closed' else 'open' end as value, 1 as authority from orders where o_orderstatus in ('F', 'O')")
def declared_classification(t):
    """Directive instances as facts of directive authority."""
    payload = F.concat(F.lit("shape "), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open"))
    d = t.orders.where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), directives.parsed(payload).alias("d"))
    return d.select("id", "kind", F.col("d.args")[0]["text"].alias("value"), F.lit(1).alias("authority"))


@query("select p_partkey, 'x.' || p_brand as described from part")
def described_types(t):
    return t.part.select("p_partkey", signatures.substituted(F.lit("x.T"), F.create_map(F.lit("T"), F.col("p_brand"))).alias("described"))


@query("select string_agg('import ' || s, chr(10) order by s) as block, lang from (select distinct source as s, lang from documents) x group by lang")
def import_lines(t):
    d = t.documents.select("lang", F.concat(F.lit("import "), "source").alias("s")).distinct()
    return d.groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list("s")), "\n").alias("block")).select("block", "lang")


@query("select event_type, count(*) as n from events group by 1")
def watch_batches(t):
    """The events as files that come in, tallied batch by batch into two sinks, of which one is read."""
    folder, events = _folder(t), t.events.select("event_id", "event_type")
    events.repartition(3).write.parquet(f"{folder}/in")
    seen: list[int] = []
    counts = lambda batch, number: batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("append").parquet(f"{folder}/counts")
    watch.watch(t.spark, f"{folder}/in", events.schema, watch.tee(counts, lambda batch, number: seen.append(number)), f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema("event_type string, n long").parquet(f"{folder}/counts").groupBy("event_type").agg(F.sum("n").alias("n"))


@query()
def frontend_lines(t):
    """A custom source over two small files."""
    folder = _folder(t).removeprefix("file://")
    os.makedirs(folder)
    for k in (1, 2):
        with open(os.path.join(folder, f"{k}.txt"), "w") as f:
            f.write("\n".join(f"+mill:mark n={j}" for j in range(k * 3)))
    frontend.register(t.spark)
    lines = t.spark.read.format("millrace_lines").option("paths", ",".join(f"{folder}/{k}.txt" for k in (1, 2))).load()
    return lines.select(F.substring_index("path", "/", -1).alias("file"), "line", text.carrier(F.col("body"), "mill").alias("c")).select("file", "line", "c.mark", "c.payload")


@query("select p_partkey, replace(p_name, ' ', '_') || '_gen.go' as file from part")
def snake_filenames(t):
    names = t.part.select("p_name").distinct()
    named = names.select("p_name", naming.snake_filename(F.concat(F.lit("x/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".go")), F.lit("gen"), F.lit(""), F.lit(".go")).alias("file"))
    return t.part.join(named, "p_name").select("p_partkey", "file")
