"""Scans, gates, sources and orders over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import changes, gates, grouping, hierarchy, linking
from ..sources import trees
from .registry import query


@query("select p_partkey, p_name from part where p_type = (select min(p_type) from part) order by p_partkey")
def enumerate_kind(t):
    kind = t.part.agg(F.min("p_type").alias("p_type"))
    return t.part.join(kind, "p_type").select("p_partkey", "p_name").orderBy("p_partkey")


@query("select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')")
def enumerate_directive(t):
    marks = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return gates.carrying(t.orders, marks, ["o_orderkey"]).select("o_orderkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey = 1 and l_linenumber = 3")
def point_lookup(t):
    return gates.lookup(t.lineitem, {"l_orderkey": 1, "l_linenumber": 3}).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select c_custkey, n_name as package, r_name as module from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def owning_package(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("n_name").alias("package"), F.col("r_name").alias("module"))


@query("select c_custkey, r_regionkey >= 3 as dependency from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def dependency_flag(t):
    packages = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", (F.col("r_regionkey") >= 3).alias("dependency"))
    return t.customer.join(packages, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "dependency")


PATH = "regexp_replace(url, '^https?://([^?#]*[^?#/])/?([?#].*)?$', '\\1')"


def _paths(t):
    return t.pages.select("page_id", F.regexp_replace("url", r"^https?://([^?#]*[^?#/])/?([?#].*)?$", "$1").alias("path"))


@query(f"with p as (select page_id, {PATH} as path from pages), d as (select page_id, path, regexp_replace(path, '/[^/]*$', '') as dir, split_part(path, '/', 2) as lang from p) select page_id, dir from d where lang = 'en' and (dir = 'blog.tionsh.example.net' or starts_with(dir, 'blog.tionsh.example.net/'))")
def sources_admit(t):
    d = _paths(t).select("page_id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.split_part("path", F.lit("/"), F.lit(2)).alias("lang"))
    return gates.admits(d, lang="en", directory="blog.tionsh.example.net/...").select("page_id", "dir")


@query("select p_partkey from part where p_brand = 'Brand#11' and p_size < 25 and not (p_type = 'PROMO')")
def gate_conjunction(t):
    return t.part.where((F.col("p_brand") == "Brand#11") & (F.col("p_size") < 25) & ~(F.col("p_type") == "PROMO")).select("p_partkey")


@query("select o_custkey from orders group by o_custkey having list_contains(list(distinct o_orderpriority), '1-URGENT')")
def has_slot(t):
    slots = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("slots"))
    return slots.where(F.array_contains("slots", "1-URGENT")).select("o_custkey")


@query("select c_custkey as subject, event_id as instance from customer join events on user_id = c_custkey where event_type in ('click', 'view')")
def gated_instances(t):
    instances = t.events.where("event_type in ('click', 'view', 'error')").select(F.col("user_id").alias("subject"), F.col("event_id").alias("instance"), (F.col("event_type") == "error").alias("negated"))
    return gates.gated(t.customer.select(F.col("c_custkey").alias("subject")), instances).select("subject", "instance")


SKIPS = "s as (select distinct user_id as subject, case when value > 90 then null else event_type end as plugin from events where event_type in ('error', 'signup') and value > 80)"


@query(f"with {SKIPS}, m as (select distinct user_id as subject, event_type as plugin from events) select m.subject, m.plugin from m where not exists (select 1 from s where s.subject = m.subject and (s.plugin is null or s.plugin = m.plugin))")
def skip_optouts(t):
    skips = t.events.where("event_type in ('error', 'signup') and value > 80").select(F.col("user_id").alias("subject"), F.when(F.col("value") <= 90, F.col("event_type")).alias("plugin"))
    matches = t.events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("plugin")).distinct()
    return gates.not_skipped(matches, skips)


@query("select event_type as rule, user_id as subject, event_id as instance, cast(row_number() over (partition by event_type order by user_id, event_id) as int) as seq from events")
def canonical_sequence(t):
    return gates.numbered(t.events.select(F.col("event_type").alias("rule"), F.col("user_id").alias("subject"), F.col("event_id").alias("instance")))


@query("select event_id from events where (user_id, event_type) in (select (user_id, event_type) from events where value > 95)")
def selective_dispatch(t):
    return gates.selected(t.events, t.events.where("value > 95"), ["user_id", "event_type"]).select("event_id")


@query("select event_id, user_id, event_type from events where value > 50 order by event_type, user_id, event_id")
def match_order(t):
    return gates.ordered(t.events.where("value > 50").select("event_id", "user_id", "event_type"), "event_type", "user_id", "event_id")


@query("select s_nationkey, l_partkey as target from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2")
def package_imports(t):
    files = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return files.select("s_nationkey", F.col("l_partkey").alias("target")).distinct()


@query("select p_brand, p_name, min(p_partkey) as p_partkey from part group by p_brand, p_name")
def declared_by_name(t):
    return linking.latest(t.part, ["p_brand", "p_name"], [F.asc("p_partkey")]).select("p_brand", "p_name", "p_partkey")


@query("select o_orderkey as owner, l_linenumber as line, l_partkey as member from orders join lineitem on l_orderkey = o_orderkey")
def flatten_declarations(t):
    """Members nested in their owners, flattened again."""
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("members"))
    owned = t.orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("owner"), F.explode("members").alias("m"))
    return owned.select("owner", F.col("m.l_linenumber").alias("line"), F.col("m.l_partkey").alias("member"))


@query(f"with p as (select page_id, {PATH} as path from pages) select page_id, path from p where starts_with(path, 'blog.')")
def prefix_scan(t):
    return trees.scan_prefix(_paths(t), "blog.", "path")


BEFORE = "b as (select event_id as path, cast(value * 10 as bigint) as size, user_id as mtime from events where event_id % 5 <> 0)"
AFTER = "a as (select event_id as path, cast(value * 10 as bigint) as size, case when event_id % 7 = 0 then user_id + 1 else user_id end as mtime from events where event_id % 5 <> 1)"


def _stats(t):
    e = t.events.select(F.col("event_id").alias("path"), F.floor(F.col("value")).alias("size"), F.col("user_id").alias("mtime"))
    return e.where("path % 5 <> 0"), e.where("path % 5 <> 1").withColumn("mtime", F.when(F.col("path") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))


STATS = (BEFORE + ", " + AFTER).replace("cast(value * 10 as bigint)", "cast(floor(value) as bigint)")


@query(f"with {STATS} select coalesce(a.path, b.path) as path, case when b.path is null then 'added' when a.path is null then 'removed' else 'changed' end as change from b full outer join a on a.path = b.path where a.path is null or b.path is null or a.mtime <> b.mtime or a.size <> b.size")
def stat_gate(t):
    was, now = _stats(t)
    return trees.suspects(now, was)


@query(f"with {STATS} select b.path, case when a.path is null then 'removed' else 'changed' end as change from b left join a on a.path = b.path where a.path is null or a.mtime <> b.mtime or a.size <> b.size")
def moved_files(t):
    was, now = _stats(t)
    return changes.moved_and_vanished(was, now)


@query(f"with p as (select page_id, {PATH} as path from pages) select page_id, concat_ws(',', case when regexp_matches(path, '^[^/]*/en/[^/]*$') then 'english' end, case when regexp_matches(path, '^([^/]+/)*[^/]*\\.html$') then 'static' end) as claimants, cast(regexp_matches(path, '^[^/]*/en/[^/]*$') as int) + cast(regexp_matches(path, '^([^/]+/)*[^/]*\\.html$') as int) > 1 as refused from p")
def glob_claims(t):
    c = trees.claims(_paths(t), {"english": ["*/en/*"], "static": ["**/*.html"]})
    return c.select("page_id", F.array_join("claimants", ",").alias("claimants"), (F.size("claimants") > 1).alias("refused"))


@query("select source, count(*) as files, sha256(string_agg(cast(doc_id as varchar) || '=' || sha256(text), ';' order by doc_id)) as unit_key from documents group by source")
def unit_keys(t):
    docs = t.documents.select("source", "doc_id", F.sha2("text", 256).alias("digest"))
    return trees.units(docs, ["source"], path="doc_id")


@query("select page_id, sha256(html) as digest from pages")
def content_digest(t):
    return t.pages.select("page_id", F.sha2("html", 256).alias("digest"))


@query("with u as (select source, sha256(string_agg(sha256(text), ';' order by doc_id)) as k from documents group by source) select source from u where k in (select k from u where source < 'src15')")
def memo_restore(t):
    u = t.documents.groupBy("source").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2("text", 256).alias("d")))), lambda x: x["d"]), ";"), 256).alias("unit_key"))
    return trees.restored(u, u.where("source < 'src15'"))[0].select("source")


@query("select p_partkey, first_value(p_name) over (partition by p_brand order by p_partkey) as package_name from part")
def splice_packages(t):
    return trees.spliced(t.part.withColumnRenamed("p_name", "name"), "p_brand", [F.asc("p_partkey")]).select("p_partkey", "package_name")


@query("select p_brand, p_name, p_type, min(p_partkey) as p_partkey, count(*) - 1 as late from part group by p_brand, p_name, p_type")
def assign_identities(t):
    identity_ = ["p_brand", "p_name", "p_type"]
    first, late = hierarchy.first_declared(t.part, identity_, [F.asc("p_partkey")])
    n = late.groupBy(*identity_).agg(F.count("*").alias("late"))
    return first.join(n, identity_, "left").select(*identity_, "p_partkey", F.coalesce("late", F.lit(0)).cast("long").alias("late"))


@query("with x as (select html || chr(10) || '// provenance ' || sha256(html) as s from pages) select count(*) as n from x")
def provenance(t):
    """Pages that are intact after being stamped."""
    return t.pages.select(text.stamped(F.col("html"), "// provenance ").alias("s")).where(text.verified(F.col("s"), "// provenance ")).agg(F.count("*").alias("n"))


@query("select substr(sha256(url), 1, 2) as bucket, count(*) as n from pages group by 1")
def hash_bucket(t):
    return t.pages.select(identity.bucket_of(F.col("url")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("select page_id, cast(cast('0x' || substr(sha256(url), 1, 16) as uhugeint) as varchar) as edge from pages")
def edge_hash(t):
    return t.pages.select("page_id", identity.edge_hash(F.col("url")).cast("string").alias("edge"))


@query("select o_orderkey, o_orderstatus from orders order by sha256(cast(o_orderkey as varchar)), o_orderkey")
def hash_sort(t):
    rows = t.orders.withColumn("h", F.sha2(F.col("o_orderkey").cast("string"), 256))
    return rows.repartitionByRange("h", "o_orderkey").sortWithinPartitions("h", "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("select p_type as kind, count(*) as n from part group by p_type")
def kind_counts(t):
    return grouping.routed(t.part.withColumnRenamed("p_type", "kind"), ["kind"])


@query("select count(*) as loaded, count(distinct user_id) as subjects, sum(case when event_type = 'error' then 1 else 0 end)::bigint as failed, max(event_id) as last from events")
def run_statistics(t):
    return t.events.agg(F.count("*").alias("loaded"), F.count_distinct("user_id").alias("subjects"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failed"), F.max("event_id").alias("last"))


@query("select user_id, event_id, cast(sum(1) over (partition by user_id order by ts, event_id) as bigint) as ord from events where event_type = 'purchase'")
def attachment_order(t):
    return hierarchy.instance_ordinals(t.events.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ord")


@query("select event_id, cast(row_number() over (partition by user_id, event_type order by ts, event_id) as bigint) as ord from events")
def instance_ordinal(t):
    return hierarchy.instance_ordinals(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "ord")


@query("select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) x where prev is null or prev <> event_type")
def watch_dedupe(t):
    from ..streaming.watch import changed_only

    return changed_only(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_totalprice > 300000 order by o_orderpriority, o_custkey, o_orderkey")
def finding_order(t):
    return gates.ordered(t.orders.where("o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderpriority", "o_custkey", "o_orderkey")


@query("select p_type, p_brand, p_name, p_partkey, cast(dense_rank() over (partition by p_type order by p_brand, p_name) as int) as rank from part")
def identity_order(t):
    return t.part.select("p_type", "p_brand", "p_name", "p_partkey", F.dense_rank().over(Window.partitionBy("p_type").orderBy("p_brand", "p_name")).alias("rank"))
