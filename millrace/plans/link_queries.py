"""Joins, satisfaction, collisions, hierarchies and grouping over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import changes, grouping, hierarchy, incremental, lineage, linking
from .registry import query
from .scan_queries import PATH, _paths


def _tiers(t):
    tier = lambda n, c: t.orders.where(c).select(F.col("o_custkey").alias("ref"), F.lit(n).alias("tier"), F.col("o_orderkey").alias("hit"))
    return tier(1, "o_orderstatus = 'O'").unionAll(tier(2, "o_orderstatus = 'F'")).unionAll(tier(3, "true"))


CAND = "cand as (select o_custkey as ref, 1 as tier, o_orderkey as hit from orders where o_orderstatus = 'O' union all select o_custkey, 2, o_orderkey from orders where o_orderstatus = 'F' union all select o_custkey, 3, o_orderkey from orders)"


@query(f"with {CAND} select ref, tier, hit from (select cand.*, min(tier) over (partition by ref) as m from cand) x where tier = m")
def first_tier(t):
    return linking.first_tier(_tiers(t)).select("ref", "tier", "hit")


@query("""with r as (select doc_id as ref, unnest([source || ':' || lang, lang || ':any', source]) as name, unnest([0, 1, 2]) as tier from documents),
d as (select lang || ':any' as name, min(doc_id) as id from documents where n_chars > 2000 group by lang union all select source, doc_id from documents where n_chars > 9000 union all select source || ':' || lang, doc_id from documents where n_chars between 1500 and 1600),
h as (select ref, tier, min(id) as target, count(distinct id) as n from r join d using (name) group by ref, tier),
f as (select * from (select *, row_number() over (partition by ref order by tier) as k from h) x where k = 1)
select doc_id as ref, f.target, coalesce(f.n > 1, false) as ambiguous from documents left join f on f.ref = doc_id""")
def link_references(t):
    d = t.documents
    refs = d.select(F.col("doc_id").alias("ref"), F.array(F.concat("source", F.lit(":"), "lang"), F.concat("lang", F.lit(":any")), "source").alias("candidates"))
    wide = d.where("n_chars > 2000").groupBy("lang").agg(F.min("doc_id").alias("id")).select(F.concat("lang", F.lit(":any")).alias("name"), "id")
    named = d.where("n_chars > 9000").select(F.col("source").alias("name"), F.col("doc_id").alias("id"))
    narrow = d.where("n_chars between 1500 and 1600").select(F.concat("source", F.lit(":"), "lang").alias("name"), F.col("doc_id").alias("id"))
    return linking.resolved(refs, wide.unionAll(named).unionAll(narrow))


@query(f"with {CAND}, x as (select cand.*, min(tier) over (partition by ref) as m from cand where ref in (select c_custkey from customer where c_acctbal > 5000)) select ref, tier, hit from x where tier = m")
def relink_delta(t):
    """Only references that probe a changed declaration are linked again."""
    delta = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("ref"))
    return linking.first_tier(_tiers(t).join(delta, "ref", "left_semi")).select("ref", "tier", "hit")


@query("select l_orderkey, l_linenumber, l_partkey, p_name from lineitem join part on p_partkey = l_partkey where p_size < 10")
def attach_to_subjects(t):
    subjects = t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return linking.attached(subjects, t.lineitem, "l_partkey")[0].select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size < 10)")
def dangling_attachments(t):
    subjects = t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return linking.attached(subjects, t.lineitem, "l_partkey")[1].select("l_orderkey", "l_linenumber", "l_partkey")


@query("with want as (select distinct o_orderpriority from orders) select o_custkey as owner from orders group by o_custkey having count(distinct o_orderpriority) = (select count(*) from want)")
def satisfies_division(t):
    return linking.satisfying(t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("member")), t.orders.select(F.col("o_orderpriority").alias("member")))


@query("with want as (select distinct o_orderpriority as member from orders), t as (select distinct o_custkey as owner from orders) select owner, member from t cross join want where not exists (select 1 from orders where o_custkey = owner and o_orderpriority = member)")
def missing_members(t):
    return linking.unsatisfied(t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("member")), t.orders.select(F.col("o_orderpriority").alias("member")))


@query("""with want as (select event_type as name, cast(min(floor(value / 25)) as bigint) as sig from events group by event_type),
m as (select distinct user_id as owner, event_type as name, cast(floor(value / 25) as bigint) as sig from events),
p as (select owner, name, max(case when m.sig = want.sig then 1 else 0 end) as ok from m join want using (name) group by owner, name)
select owner, cast(sum(ok) as bigint) as matched, cast(sum(1 - ok) as bigint) as mismatched, (select count(*) from want) - count(*) as missing from p group by owner""")
def compare_members(t):
    m = t.events.select(F.col("user_id").alias("owner"), F.col("event_type").alias("name"), F.floor(F.col("value") / 25).alias("sig"))
    return linking.compared(m, m.groupBy("name").agg(F.min("sig").alias("sig")))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def audit_missing(t):
    return linking.missing(t.orders.select("o_orderkey"), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


SUP = "sup as (select distinct user_id, event_type from events where value > 90)"


@query(f"with {SUP} select event_id from events e where event_type = 'error' or not exists (select 1 from sup where sup.user_id = e.user_id and sup.event_type = e.event_type)")
def suppress(t):
    return linking.suppressed(t.events, t.events.where("value > 90"), ["user_id", "event_type"], F.col("event_type") == "error").select("event_id")


@query("with sup as (select distinct c_custkey as user_id, 'click' as event_type from customer) select user_id, event_type from sup where not exists (select 1 from events e where e.user_id = sup.user_id and e.event_type = sup.event_type and value > 50)")
def unused_suppressions(t):
    sup = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("click").alias("event_type"))
    return linking.missing(sup, t.events.where("value > 50"), ["user_id", "event_type"])


@query(f"with {SUP} select e.event_type, e.user_id, count(*) as n from events e join sup using (user_id, event_type) group by all")
def removed_counts(t):
    marks = t.events.where("value > 90").select("user_id", "event_type").distinct()
    return grouping.routed(t.events.join(marks, ["user_id", "event_type"], "left_semi"), ["event_type", "user_id"])


@query("select event_type, user_id, case when grouping(user_id) = 0 then 1 else 0 end as level, count(*) as n from events group by grouping sets ((event_type, user_id), (event_type))")
def suppression_report(t):
    return grouping.two_level_counts(t.events, "event_type", "user_id").select("event_type", "user_id", "level", "n")


@query("with s as (select o_orderkey as path, o_orderstatus as h from orders where o_orderkey % 3 <> 0), d as (select o_orderkey as path, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as h from orders where o_orderkey % 3 <> 1) select coalesce(s.path, d.path) as path, case when d.path is null then 'created' when s.path is null then 'deleted' when s.h = d.h then 'unchanged' else 'updated' end as action from s full outer join d on d.path = s.path")
def reconcile(t):
    return linking.reconciled(*_staged(t))


def _staged(t):
    o = t.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("digest"))
    return o.where("path % 3 <> 0"), o.where("path % 3 <> 1").withColumn("digest", F.when(F.col("path") % 5 == 0, "X").otherwise(F.col("digest")))


@query("with s as (select o_orderkey as path, o_orderstatus as h from orders where o_orderkey % 3 <> 0), d as (select o_orderkey as path, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as h from orders where o_orderkey % 3 <> 1) select s.path from s left join d using (path) where d.path is null or d.h <> s.h")
def out_of_date(t):
    """A dry run: what a commit would write."""
    return linking.reconciled(*_staged(t)).where("action in ('created', 'updated')").select("path")


@query("with u as (select o_orderkey as path, 1 as layer, o_orderstatus as v from orders where o_orderkey % 2 = 0 union all select o_orderkey, 2, o_orderpriority from orders where o_orderkey % 3 = 0) select path, v, layer from (select u.*, row_number() over (partition by path order by layer desc) as k from u) x where k = 1")
def manifest_precedence(t):
    kept = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("v"))
    fresh = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("v"))
    return linking.merged_by_precedence([kept, fresh])


PATHS = "p as (select distinct path from (select c_mktsegment || '/' || substr(c_name, 1, 17) as path from customer union all select case when c_custkey % 9 = 0 then lower(c_mktsegment) else c_mktsegment end || '/' || substr(c_name, 1, 17) || case when c_custkey % 4 = 0 then '/x' else '' end from customer) x)"


@query(f"""with {PATHS}, f as (select path, lower(path) as f from p), s as (select f, count(*) as n from f group by f)
select path, case when s.n > 1 then 'case' when exists (select 1 from f g where starts_with(g.f, f.f || '/')) then 'directory' when exists (select 1 from f g where starts_with(f.f, g.f || '/')) then 'file' else 'none' end as clash from f join s using (f)""")
def path_clash(t):
    c = t.customer
    one = c.select(F.concat("c_mktsegment", F.lit("/"), F.substring("c_name", 1, 17)).alias("path"))
    two = c.select(F.concat(F.when(F.col("c_custkey") % 9 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit("/"), F.substring("c_name", 1, 17), F.when(F.col("c_custkey") % 4 == 0, "/x").otherwise("")).alias("path"))
    return linking.clashes(one.union(two))


@query("select lower(p_name) as path, count(*) as n from part group by 1 having count(*) > 1")
def name_collision(t):
    return linking.collisions(t.part.select(F.lower("p_name").alias("path")), "path")


@query("select p_name from part group by p_name having count(distinct p_brand) > 1")
def mixed_packages(t):
    return linking.mixed(t.part, "p_name", "p_brand")


@query("select l_orderkey as ref, l_linenumber as line, l_suppkey as target, nullif(s_nationkey, cast(l_orderkey % 25 as int)) as qualifier from lineitem left join supplier on s_suppkey = l_suppkey")
def qualify_references(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("target"), (F.col("l_orderkey") % 25).cast("int").alias("package"))
    return linking.qualified(refs, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("package"))).select("ref", "line", "target", "qualifier")


@query("select l_orderkey as owner from lineitem group by l_orderkey having bool_and(l_suppkey in (select s_suppkey from supplier where s_acctbal > -500))")
def importable_owners(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_suppkey").alias("target"))
    return linking.importable(refs, t.supplier.where("s_acctbal > -500").select(F.col("s_suppkey").alias("target")))


@query("select o_orderkey, l_linenumber, l_partkey, l_suppkey from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'P'")
def export_lookup(t):
    return t.orders.where("o_orderstatus = 'P'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"with p as (select page_id, {PATH} as path from pages), d as (select distinct split_part(path, '/', 1) as root from p union select distinct regexp_replace(path, '/[^/]*$', '') from p where page_id % 3 = 0) select p.page_id, max_by(root, length(root)) as root from p join d on p.path = root or starts_with(p.path, root || '/') group by p.page_id")
def longest_prefix(t):
    p = _paths(t)
    roots = p.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).union(p.where("page_id % 3 = 0").select(F.regexp_replace("path", "/[^/]*$", "")))
    return linking.longest_prefix(p, F.col("path"), roots).select("page_id", "root")


@query(f"with p as (select page_id, regexp_replace({PATH}, '/[^/]*$', '') as dir from pages), m as (select distinct dir from p where page_id % 5 = 0 union select distinct split_part(dir, '/', 1) from p where page_id % 7 = 0), h as (select p.dir, max_by(m.dir, length(m.dir)) as nearest from (select distinct dir from p) p join m on p.dir = m.dir or starts_with(p.dir, m.dir || '/') group by p.dir) select p.page_id, h.nearest from p left join h using (dir)")
def nearest_ancestor(t):
    p = _paths(t).select("page_id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    marks = p.where("page_id % 5 = 0").select("dir").union(p.where("page_id % 7 = 0").select(F.split_part("dir", F.lit("/"), F.lit(1))))
    return linking.nearest_ancestor(p, "dir", marks).select("page_id", "nearest")


@query(f"with p as (select regexp_replace({PATH}, '/[^/]*$', '') as dir, page_id from pages) select dir, string_agg(cast(page_id as varchar), ',' order by page_id) as residents from p group by dir")
def directory_residents(t):
    p = _paths(t).select("page_id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    return grouping.accumulated(p, ["dir"], ["page_id"], "page_id", "residents")


@query(f"with p as (select {PATH} as path from pages) select split_part(path, '/', 1) as module, count(*) as n, max(len(string_split(path, '/'))) as depth from p group by 1")
def module_counts(t):
    p = _paths(t)
    return p.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).agg(F.count("*").alias("n"), F.max(F.size(F.split("path", "/"))).cast("long").alias("depth"))


@query("select o_custkey as instance, o_orderstatus as contract, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as members from orders group by 1, 2")
def contract_instances(t):
    return grouping.accumulated(t.orders.select(F.col("o_custkey").alias("instance"), F.col("o_orderstatus").alias("contract"), "o_orderkey"), ["instance", "contract"], ["o_orderkey"], "o_orderkey")


@query("with b as (select distinct p_brand as n from part) select a.n as a, b.n as b, damerau_levenshtein(a.n, b.n) as d from b a, b where a.n < b.n and damerau_levenshtein(a.n, b.n) <= 2 and 3 * damerau_levenshtein(a.n, b.n) <= greatest(strlen(a.n), strlen(b.n))")
def near_name(t):
    """Registered names are few; a name is compared with those of nearly its length."""
    n = t.part.select(F.col("p_brand").alias("a"), F.octet_length("p_brand").alias("la")).distinct()
    m = n.select(F.col("a").alias("b"), F.explode(F.sequence(F.col("la") - 2, F.col("la") + 2)).alias("la"))
    return n.join(m, "la").where("a < b").where(naming.near(F.col("a"), F.col("b"))).select("a", "b", naming.distance(F.col("a"), F.col("b")).alias("d"))


@query("with p as (select o_custkey as k, max(case when o_orderpriority = '1-URGENT' then o_orderstatus end) as a, max(o_orderstatus) as b from orders group by o_custkey) select c_custkey, coalesce(a, b, 'default') as choice from customer left join p on k = c_custkey")
def policy_resolution(t):
    override = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("s"))
    chosen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("s"))
    return linking.coalesced(t.customer.select("c_custkey"), "c_custkey", [(override, "s"), (chosen, "s")], default="default")


ALIAS = "e as (select p_partkey as id, cast(floor(p_partkey / 3.0) as bigint) as tgt from part)"


@query(f"with recursive {ALIAS}, c(id, cur, hop) as (select id, id, 0 from e union all select c.id, e.tgt, c.hop + 1 from c join e on e.id = c.cur where c.hop < 8 and c.cur > 0) select id, max_by(cur, hop) as cur, max(hop) as hop from c group by id")
def alias_chase(t):
    return hierarchy.chased(t.part.select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("target")), stop=F.col("id") <= 0)


@query("with recursive e as (select distinct l_suppkey as s, l_partkey % 100 as d from lineitem), c(s, d, hop) as (select s, d, 0 from e union select c.s, e.d, c.hop + 1 from c join e on e.s = c.d where c.hop < 2) select s as package, d as exported, min(hop) as hop from c group by 1, 2")
def reexport_chase(t):
    return hierarchy.reexported(t.lineitem.select(F.col("l_suppkey").alias("package"), (F.col("l_partkey") % 100).alias("exported")), 2)


@query("select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderdate, o_orderkey) as members from orders group by o_custkey")
def accumulate(t):
    return grouping.accumulated(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("select l_suppkey, l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def route_files(t):
    return grouping.routed(t.lineitem, ["l_suppkey", "l_returnflag", "l_linestatus"])


@query("select o_custkey, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as sources from orders group by o_custkey")
def derivation(t):
    return grouping.distinct_sorted(t.orders, ["o_custkey"], "o_orderstatus", "sources")


@query("select o_custkey, max(o_orderpriority) as header, count(distinct o_orderpriority) as parts from orders group by o_custkey")
def header_merge(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("header"), F.count_distinct("o_orderpriority").alias("parts"))


@query("select user_id, string_agg(distinct event_type, ',' order by event_type) as readers from events group by user_id")
def inverted_index(t):
    return grouping.distinct_sorted(t.events, ["user_id"], "event_type", "readers")


@query("with prior as (select distinct l_suppkey as edge, l_orderkey as record from lineitem), n as (select * from prior where record % 4 <> 0 union select distinct l_partkey % 100, l_orderkey from lineitem where l_orderkey % 4 = 0) select edge, count(*) as n from n group by edge")
def merged_index(t):
    r = t.lineitem.select(F.col("l_suppkey").alias("edge"), F.col("l_orderkey").alias("record"), "l_partkey")
    touched = r.where("record % 4 = 0")
    return grouping.merged_index(r, touched.withColumn("edge", F.col("l_partkey") % 100), touched).groupBy("edge").agg(F.count("*").alias("n"))


VALID = "i as (select user_id as subject, event_type as name, value < 10 as negated from events), p as (select subject, name, sum(case when negated then 0 else 1 end) as yes, sum(case when negated then 1 else 0 end) as no from i group by all)"


@query(f"""with {VALID} select subject, 'duplicate' as fault, name from p where (yes > 1 or no > 1) and name not in ('view', 'click') union all select subject, 'polarity', name from p where yes > 0 and no > 0
union all select a.subject, 'requires', 'purchase' from p a where a.name = 'purchase' and a.yes > 0 and not exists (select 1 from p b where b.subject = a.subject and b.name = 'signup' and b.yes > 0)
union all select a.subject, 'conflicts', 'error' from p a where a.name = 'error' and a.yes > 0 and exists (select 1 from p b where b.subject = a.subject and b.name = 'view' and b.yes > 0)""")
def directive_validation(t):
    i = t.events.select(F.col("user_id").alias("subject"), F.col("event_type").alias("name"), (F.col("value") < 10).alias("negated"))
    return grouping.validated(i, ["view", "click"], [("purchase", "signup")], [("error", "view")])


@query("with spec as (select * from (values ('view', 1, 12), ('purchase', 1, null), ('error', 0, 8)) s(role, lo, hi)), u as (select distinct user_id as unit from events) select unit, role, count(event_id) as n from u cross join spec left join events on user_id = unit and event_type = role group by unit, role, lo, hi having count(event_id) < lo or count(event_id) > hi")
def role_arity(t):
    uses = t.events.select(F.col("user_id").alias("unit"), F.col("event_type").alias("role"))
    return grouping.arity_faults(uses, uses, [("view", 1, 12), ("purchase", 1, None), ("error", 0, 8)])


@query("select p_brand, p_name, min(p_partkey) as first, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as overloads from part group by all")
def overload_groups(t):
    g = grouping.accumulated(t.part, ["p_brand", "p_name"], ["p_partkey"], "p_partkey", "overloads")
    return g.select("p_brand", "p_name", F.substring_index("overloads", ",", 1).cast("long").alias("first"), "overloads")


TREE = "e as (select p_partkey as id, cast(floor((p_partkey - 1) / 7.0) as bigint) as parent, p_brand as name, p_type as sig from part where p_partkey > 0)"
WALK = "r(root, id, name, sig, depth) as (select p_partkey, p_partkey, p_brand, p_type, 0 from part where p_partkey > 0 union all select r.root, e.id, e.name, e.sig, r.depth + 1 from r join e on e.parent = r.id where r.depth < 8)"


def _tree(t):
    return t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.floor((F.col("p_partkey") - 1) / 7).alias("parent"), F.col("p_brand").alias("name"), F.col("p_type").alias("sig"))


def _walk(t):
    """From every node, to the depth that a walk has by default."""
    nodes = _tree(t)
    return hierarchy.walked(nodes, nodes)


@query(f"with recursive {TREE}, {WALK} select root, id, name, depth from r")
def member_walk(t):
    return _walk(t).select("root", "id", "name", "depth")


@query(f"with recursive {TREE}, {WALK}, l as (select p_partkey as id, p_partkey * 3 as target from part where p_size < 20) select root, id, target, 'unresolved' as reason from r join l using (id) where not exists (select 1 from e where e.id = target)")
def walk_gaps(t):
    links = t.part.where("p_size < 20").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 3).alias("target"))
    return hierarchy.gaps(_walk(t), links, _tree(t)).where("reason = 'unresolved'")


@query(f"with recursive {TREE}, {WALK}, m as (select r.*, min(depth) over (partition by root, name) as md, count(*) over (partition by root, name, depth) as n from r) select root, name, id, depth from m where depth = md and (depth = 0 or n = 1)")
def shadow_promote(t):
    return hierarchy.promoted(_walk(t)).select("root", "name", "id", "depth")


@query(f"with recursive {TREE}, {WALK}, m as (select r.*, row_number() over (partition by root, name, sig order by depth, id) as k from r) select root, name, sig, id, depth from m where k = 1")
def shadow_override(t):
    return hierarchy.overridden(_walk(t)).select("root", "name", "sig", "id", "depth")


@query(f"with recursive {TREE}, {WALK}, m as (select r.*, min(depth) over (partition by root, name) as md from r) select root, name, id, depth from m where depth = 0 or md > 0")
def shadow_merge(t):
    return hierarchy.merged(_walk(t)).select("root", "name", "id", "depth")


@query(f"with recursive {TREE}, {WALK}, o as (select r.*, cast(floor((id - 1) / 7.0) as bigint) as owner from r where depth > 0), a as (select root, owner, row_number() over (partition by root order by min(depth), owner) as at_ from o group by root, owner), p as (select o.*, at_, min(at_) over (partition by root, name) as m from o join a using (root, owner)) select root, name, id, owner from p where at_ = m")
def shadow_linearise(t):
    """Members of the first owner; here owners stand level by level, as the C3 order of a tree has them."""
    m = _walk(t).where("depth > 0").withColumn("owner", F.floor((F.col("id") - 1) / 7))
    owners = m.groupBy("root", "owner").agg(F.min("depth").alias("d"))
    order = hierarchy.instance_ordinals(owners, ["root"], ["d", "owner"], "at").drop("d")
    return hierarchy.first_owner(m, order).select("root", "name", "id", "owner")


@query(f"with recursive {TREE}, {WALK}, m as (select r.*, first_value(sig) over w as f, row_number() over w as k from r window w as (partition by root, name order by depth, id)) select root, name, id, sig, 'conflict' as reason from m where k > 1 and sig <> f")
def interface_conflicts(t):
    return hierarchy.interface_members(_walk(t))[1].select("root", "name", "id", "sig", F.lit("conflict").alias("reason"))


@query("select p_partkey, cast(row_number() over (partition by p_type order by f, p_brand, m, p_partkey) as int) as at from (select *, min(p_partkey) over (partition by p_type, p_brand) as f, case when p_size > 25 then 1 else 0 end as m from part) x")
def signature_blocks(t):
    rows = t.part.withColumn("m", F.when(F.col("p_size") > 25, 1).otherwise(0))
    return hierarchy.signature_blocks(rows, "p_type", "p_brand", "p_partkey", "m").select("p_partkey", "at")


@query("select p_partkey, min(p_type) over (partition by p_brand, p_size) <> max(p_type) over (partition by p_brand, p_size) as ambiguous from part")
def ambiguous_names(t):
    return hierarchy.ambiguous(t.part, ["p_brand", "p_size"], "p_type").select("p_partkey", "ambiguous")


@query()
def c3_orders(t):
    """The C3 orders of the part hierarchy, in which every node has two bases, over all that is above each node."""
    p = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("node"))
    bases = F.array_distinct(F.array(F.floor(F.col("node") / 2), F.floor(F.col("node") / 3)))
    edges = p.select("node", F.posexplode(bases).alias("pos", "base")).where("base > 0")
    return hierarchy.level_orders(p, edges).join(edges.select(F.col("node").alias("root")).distinct(), "root", "left_semi")


@query()
def topological_order(t):
    """Declarations of each file in an order in which each comes after what it needs."""
    items = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("pos")).repartition("unit").groupBy("unit", "item").agg(F.min("pos").alias("pos"))
    needs = items.join(items.select("unit", F.col("item").alias("need")), "unit").where("item <> need and need % 5 = item % 3").select("unit", "item", "need")
    return hierarchy.topological_orders(items, needs)


@query("with d as (select event_id, user_id, event_type from events where event_id % 5 <> 0), a as (select event_id, user_id, case when event_id % 7 = 0 then 'view' else event_type end as event_type from events where event_id % 5 <> 1) select coalesce(a.event_id, d.event_id) as event_id, case when d.event_id is null then 'added' when a.event_id is null then 'removed' else 'changed' end as change from d full outer join a on a.event_id = d.event_id where d.event_id is null or a.event_id is null or a.event_type <> d.event_type or a.user_id <> d.user_id")
def generation_diff(t):
    before, after = _generations(t)
    return changes.generation_diff(before, after, ["event_id"], ["user_id", "event_type"])


def _generations(t):
    e = t.events.select("event_id", "user_id", "event_type")
    return e.where("event_id % 5 <> 0"), e.where("event_id % 5 <> 1").withColumn("event_type", F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type")))


GENS = "b as (select event_id, user_id, event_type from events where event_id % 5 <> 0), a as (select event_id, user_id, case when event_id % 7 = 0 then 'view' else event_type end as event_type from events where event_id % 5 <> 1)"


@query(f"with {GENS}, x as (select user_id, string_agg(event_id || event_type, ',' order by event_id) as s from b where event_type = 'signup' group by 1), y as (select user_id, string_agg(event_id || event_type, ',' order by event_id) as s from a where event_type = 'signup' group by 1) select coalesce(x.user_id, y.user_id) as user_id from x full outer join y using (user_id) where x.s is distinct from y.s")
def attachment_diff(t):
    before, after = (g.where("event_type = 'signup'") for g in _generations(t))
    return changes.differing_lists(before, after, "user_id", ["event_id"], "event_type")


@query(f"with {GENS}, x as (select distinct user_id, event_type, event_id % 1000 as slot from b), y as (select distinct user_id, event_type, event_id % 1000 from a) select * from ((select * from x except select * from y) union all (select * from y except select * from x)) z")
def edge_symmetric_difference(t):
    before, after = (g.select("user_id", "event_type", (F.col("event_id") % 1000).alias("slot")) for g in _generations(t))
    return changes.symmetric_difference(before, after)


@query(f"with {GENS} select coalesce(a.event_id, b.event_id) as event_id, a.event_type, a.event_id is null as dead from b full outer join a on a.event_id = b.event_id where a.event_id is null or b.event_id is null or a.event_type <> b.event_type")
def row_diff(t):
    before, after = _generations(t)
    return changes.row_diff(before, after, "event_id", "event_type")


@query("with r as (select o_orderkey // 3 as k, o_orderkey as v, cast(o_orderkey % 3 as int) as run, o_orderstatus = 'F' as dead from orders), n as (select *, row_number() over (partition by k order by run desc) as i from r) select k, v, run from n where i = 1 and not dead")
def sorted_run_merge(t):
    r = t.orders.select(F.floor(F.col("o_orderkey") / 3).alias("k"), F.col("o_orderkey").alias("v"), (F.col("o_orderkey") % 3).cast("int").alias("run"), (F.col("o_orderstatus") == "F").alias("dead"))
    return changes.newest(r, "k").select("k", "v", "run")


@query("select p_partkey as line, p_name as text from part where p_partkey % 2 = 0 and p_name not in (select p_name from part where p_partkey % 2 = 1 and p_size < 2)")
def removed_lines(t):
    p = t.part.select(F.col("p_partkey").alias("line"), F.col("p_name").alias("text"), "p_size")
    return changes.lost_lines(p.where("line % 2 = 0"), p.where("line % 2 = 1 and p_size < 2"), "text").select("line", "text")


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def manifest_survivors(t):
    stale = t.orders.where("o_orderstatus = 'O'").withColumnRenamed("o_custkey", "c_custkey")
    return linking.missing(stale, t.customer.where("c_acctbal < 0"), ["c_custkey"]).select("o_orderkey")


@query("select distinct l_suppkey as edge, l_orderkey as record from lineitem where l_returnflag = 'A'")
def read_set(t):
    return t.lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("edge"), F.col("l_orderkey").alias("record")).dropDuplicates()


@query("select p_partkey as id, case when not exists (select 1 from part q where q.p_size < 10 and q.p_name = part.p_name) then part.p_name else part.p_name || '0' end as name from part where p_size >= 10")
def first_free_name(t):
    wanted = t.part.where("p_size >= 10").select(F.col("p_partkey").alias("id"), "p_name")
    return changes.first_free(wanted, t.part.where("p_size < 10").select(F.col("p_name").alias("name")), F.array("p_name"))


def _dirty_sql(hops: int) -> str:
    """Level by level; the tables take few, since a supplier has orders with most others."""
    levels = ["with reads as (select distinct l_suppkey as edge, l_orderkey as rec from lineitem), r0 as (select distinct rec, 0 as hop from reads where edge % 50 = 1), s0 as (select * from r0)"]
    for k in range(1, hops + 1):
        levels.append(f"r{k} as (select distinct rec, {k} as hop from reads where edge in (select edge from reads where rec in (select rec from r{k - 1})) and rec not in (select rec from s{k - 1})), s{k} as (select * from s{k - 1} union all select * from r{k})")
    return f"{', '.join(levels)} select rec as record, hop from s{hops}"


@query(_dirty_sql(6))
def dirty_fixpoint(t):
    reads = t.lineitem.select(F.col("l_suppkey").alias("edge"), F.col("l_orderkey").alias("record"))
    return incremental.dirty_records(reads, reads.where("edge % 50 = 1"))


@query("with recursive m as (select distinct o_orderkey as g, unnest([o_custkey, o_custkey + 7]) as f from orders), e as (select distinct o_custkey as f, o_custkey + 7 as h from orders), c(f) as (select distinct f from m where g in (select g from m where f < 60) union select case when e.f = c.f then e.h else e.f end from c join e on c.f = e.f or c.f = e.h) select distinct g as \"group\" from m where f in (select f from c)")
def group_closure(t):
    m = t.orders.select(F.col("o_orderkey").alias("group"), F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 7)).alias("file"))
    return incremental.closure_of_groups(m.where("file < 60"), m)


@query("with recursive n as (select p_partkey as u, cast(floor(p_partkey / 2.0) as bigint) as d from part union all select p_partkey, cast(floor(p_partkey / 5.0) as bigint) from part), c(u) as (select p_partkey from part where p_size = 50 union select n.d from c join n on n.u = c.u) select u as unit from c where u not in (select p_partkey from part where p_size < 20)")
def dependency_rounds(t):
    p = t.part
    needs = p.select(F.col("p_partkey").alias("unit"), F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 5))).alias("need"))
    return incremental.needed(p.where("p_size = 50").select(F.col("p_partkey").alias("unit")), needs, p.where("p_size < 20").select(F.col("p_partkey").alias("unit")))


@query("with recursive e as (select * from (values ('app', 'api'), ('api', 'model'), ('docs', 'model'), ('model', 'base'), ('cli', 'app')) v(p, n)), s(p) as (select 'app' union select e.n from s join e on e.p = s.p) select p as plan from s")
def plan_selection(t):
    from .rules import selected_plans

    plans = selected_plans(["app"], {"app": ["api"], "api": ["model"], "docs": ["model"], "model": ["base"], "cli": ["app"]})
    return t.spark.createDataFrame([(p,) for p in plans], "plan string")


@query("select event_id, user_id from events where user_id % 4 <> 0 union all select event_id + 1000000, user_id from events where user_id % 4 = 0 and value > 50")
def replayed_findings(t):
    e = t.events.select("event_id", "user_id", "value")
    rerun = e.where("user_id % 4 = 0")
    return incremental.replayed(e.drop("value"), rerun.where("value > 50").select((F.col("event_id") + 1000000).alias("event_id"), "user_id"), rerun, "user_id")


@query(f"with {GENS}, x as (select event_type as kind, user_id as package, event_id as id from b), y as (select event_type, user_id, event_id from a) select distinct kind, package from ((select * from x except select * from y) union all (select * from y except select * from x)) z")
def membership_edges(t):
    before, after = (g.select(F.col("event_type").alias("kind"), F.col("user_id").alias("package"), F.col("event_id").alias("id")) for g in _generations(t))
    return incremental.membership_edges(before, after)


@query("select o_orderkey as \"check\" from orders where o_orderkey not in (select l_orderkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0))")
def check_reuse(t):
    reads = t.lineitem.select(F.col("l_orderkey").alias("check"), F.col("l_suppkey").alias("edge"))
    return incremental.reusable(t.orders.select(F.col("o_orderkey").alias("check")), reads, t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("edge")))


@query("select o_orderkey from orders where o_orderpriority not in (select o_orderpriority from orders where o_totalprice > 100000 and o_orderpriority < '3')")
def prune_sweep(t):
    declared = t.orders.where("o_totalprice > 100000 and o_orderpriority < '3'").select("o_orderpriority")
    return linking.missing(t.orders, declared, ["o_orderpriority"]).select("o_orderkey")


@query("select distinct l_orderkey as record, l_suppkey as source from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey = 7)")
def explain_path(t):
    artifacts = t.orders.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("record"))
    return lineage.explain_path(7, artifacts, t.lineitem.select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("source")))


@query("select distinct l_orderkey as record from lineitem where l_suppkey = 5")
def explain_identity(t):
    return lineage.explain_identity(5, t.lineitem.select(F.col("l_suppkey").alias("edge"), F.col("l_orderkey").alias("record")))


@query("select event_id as record, c_name from events join customer on c_custkey = user_id where event_type = 'error' and user_id = 12")
def explain_finding(t):
    found = t.events.select(F.col("event_id").alias("record"), F.col("event_type").alias("code"), F.col("user_id").alias("pos"))
    runs = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey")).select(F.col("event_id").alias("record"), "c_name")
    return lineage.explain_finding(found, runs, "error", 12).select("record", "c_name")


@query("select event_type as feature, min(case when user_id % 3 = 0 then value end) as a, min(case when user_id % 3 = 1 then value end) as b, min(case when user_id % 3 = 2 then value end) as c from events group by 1")
def support_matrix(t):
    v = t.events.select(F.col("event_type").alias("feature"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int")).alias("lang"), "value")
    return lineage.support_matrix(v, "feature", "lang", ["a", "b", "c"], "value")


@query("select l_suppkey as edge, count(distinct l_orderkey) as readers from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 5) group by 1")
def reverse_reads(t):
    dirty = t.supplier.where("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"))
    return t.lineitem.join(dirty, "l_suppkey", "left_semi").groupBy(F.col("l_suppkey").alias("edge")).agg(F.count_distinct("l_orderkey").alias("readers"))
