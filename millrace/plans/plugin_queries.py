"""Rounds, rules over all kinds, stages of emitting and typed keys over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, templates
from ..operators import emitting as emitting_
from ..operators import facts, incremental, rounds
from .registry import query
from .rules import KINDS, Plugin, condition, dispatched, emits, emitting, gated, has_key, on, staged, where

# Parts form a tree; a part's result is its size and half of its parent's result, and no more than 40.
ROUNDS = """
v(id, was, now) as (select p_partkey, least(40, case when p_partkey % 50 = 1 then p_size + 9 else p_size end), least(40, p_size) from part where p_partkey = 1
  union all select p_partkey, least(40, case when p_partkey % 50 = 1 then p_size + 9 else p_size end + was // 2), least(40, p_size + now // 2) from part join v on p_partkey // 2 = id where p_partkey > 1)"""


def _rounds(t):
    """Results as they were when every fiftieth part was larger, and the rounds since."""
    p = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("group"), F.col("p_size").alias("size"))
    reads = p.where("group > 1").select("group", F.floor(F.col("group") / 2).alias("read"))
    was = p.withColumn("size", F.when(F.col("group") % 50 == 1, F.col("size") + 9).otherwise(F.col("size")))

    def run_over(inputs):
        def run(groups, results):
            above = results.select(F.col("group").alias("read"), F.col("value").alias("above"))
            rows = inputs.join(incremental.dealt(groups), "group").withColumn("read", F.floor(F.col("group") / 2)).join(incremental.dealt(above), "read", "left")
            return rows.select("group", F.least(F.lit(40), F.col("size") + F.floor(F.coalesce("above", F.lit(0)) / 2)).cast("int").alias("value"))

        return run

    before, _ = rounds.cold(p.select("group"), reads, run_over(was), "group long, value int")
    after, history = rounds.warm(before, reads, p.where("group % 50 = 1").select("group"), run_over(p))
    return before, after, history


@query(f"with recursive {ROUNDS} select id, cast(now as int) as value from v")
def warm_rounds(t):
    """The results after the change; a run from nothing gives the same."""
    return _rounds(t)[1].select(F.col("group").alias("id"), "value")


@query(f"with recursive {ROUNDS} select id, cast(was as int) as was, cast(now as int) as now from v where was <> now")
def moved_results(t):
    """Groups whose results the rounds have changed, with both."""
    before, after, history = _rounds(t)
    ran = history.select("group").distinct()
    both = before.join(incremental.dealt(ran), "group").withColumnRenamed("value", "was").join(incremental.dealt(after.withColumnRenamed("value", "now")), "group")
    return both.where("was <> now").select(F.col("group").alias("id"), "was", "now")


# The same symbols, facts, directives and opt-outs as _symbols.
SYMBOLS = f"""
s as (select p_partkey as subject, cast(p_partkey % 13 as int) as i, {list(KINDS)}[p_partkey % 13 + 1] as kind, p_brand as name, p_size from part),
h as (select l_partkey as subject, 'returned' as key, max(l_linestatus) as value from lineitem where l_returnflag = 'R' and l_quantity > 40 group by 1),
d as (select distinct l_partkey as subject, 'mark' as name, l_orderkey as instance, l_returnflag = 'R' as negated from lineitem where l_quantity > 46),
skip as (select p_partkey as subject, case when p_size = 9 then 'k4' end as plugin from part where p_size in (7, 9)),
open_ as (select s.*, 'k' || i as plugin from s where not exists (select 1 from skip k where k.subject = s.subject and (k.plugin is null or k.plugin = 'k' || s.i)))"""


def _symbols(t):
    i = (F.col("p_partkey") % 13).cast("int")
    symbols = t.part.select(F.col("p_partkey").alias("subject"), F.array(*map(F.lit, KINDS))[i].alias("kind"), F.col("p_brand").alias("name"), "p_size")
    returned = t.lineitem.where("l_returnflag = 'R' and l_quantity > 40").groupBy(F.col("l_partkey").alias("subject"))
    holding = returned.agg(F.lit("returned").alias("key"), F.max("l_linestatus").alias("value")).select("subject", "key", "value")
    marks = t.lineitem.where("l_quantity > 46").select(F.col("l_partkey").alias("subject"), F.lit("mark").alias("name"), F.col("l_orderkey").alias("instance"), (F.col("l_returnflag") == "R").alias("negated")).distinct()
    skips = t.part.where("p_size in (7, 9)").select(F.col("p_partkey").alias("subject"), F.when(F.col("p_size") == 9, "k4").alias("plugin"))
    return symbols, holding, marks, skips


@query(f"""with {SYMBOLS} select plugin, subject, kind as key, name as value from open_ where i % 4 = 0 or i % 4 = 1 and p_size > i or i % 4 = 2 and subject in (select subject from h where value = 'O')
  union all select 'k' || i, s.subject, kind, cast(instance as varchar) from s join d using (subject) where i % 4 = 3 and not negated""")
def trigger_kinds(t):
    """Rules for all thirteen kinds, plain, behind a condition, behind a fact and of a directive, over one scan of the symbols."""
    plugins = []
    for k, kind in enumerate(KINDS):
        by_instance = emits(F.col("subject"), F.col("kind").alias("key"), F.col("instance").cast("string").alias("value"))
        rule = on(kind, by_instance if k % 4 == 3 else emits(F.col("subject"), F.col("kind").alias("key"), F.col("name").alias("value")))
        behind = {0: lambda r: [r], 1: lambda r, k=k: where(condition(F.col("p_size") > k), r), 2: lambda r: where(("equals", ("returned", "O")), r), 3: lambda r: gated("mark", r)}[k % 4]
        plugins.append(Plugin(f"k{k}").handle(behind(rule)))
    return dispatched(plugins, *_symbols(t), "subject long, key string, value string")


@query(f"""with {SYMBOLS}, one as (select subject, 'Get' || name as name, p_size from s where kind in ('struct', 'interface') and subject not in (select subject from skip where plugin is null)),
two as (select subject, name || 'Test' as name, p_size from one where subject in (select subject from h)),
three as (select subject, two.name || instance as name, p_size from two join d using (subject) where not negated)
select 1 as stage, 'accessors' as plugin, subject, 'method' as kind, name, p_size from one union all select 2, 'tests', subject, 'function', name, p_size from two union all select 3, 'cases', subject, 'constant', name, p_size from three""")
def emit_stages(t):
    """What rules emit is matched in turn: accessors of types, tests of accessors, cases of tests, each gated by its origin."""

    def row(kind, name):
        return emits(F.col("subject"), F.lit(kind).alias("kind"), name.alias("name"), F.col("p_size"))

    accessor = row("method", F.concat(F.lit("Get"), "name"))
    first = Plugin("accessors").handle(emitting(["method"], on("struct", accessor), on("interface", accessor)))
    second = Plugin("tests").handle(where(has_key("returned"), *emitting(["function"], on("method", row("function", F.concat("name", F.lit("Test")))))))
    third = Plugin("cases").handle(gated("mark", *emitting(["constant"], on("function", row("constant", F.concat("name", F.col("instance").cast("string")))))))
    symbols, *gates = _symbols(t)
    kinds = symbols.where(F.col("kind").isin("struct", "interface"))
    return staged([first, second, third], kinds, *gates, "subject long, kind string, name string, p_size int")


def _typed(t):
    """Keys of six types, claims on them from three tables, and the keys."""
    known = keys.Registry()
    known.claim("sales", "queries")
    register = lambda name, kind, doc, **more: known.register("queries", f"sales.{name}", kind, doc, **more)
    active = register("active", "boolean", "has an order of status O", group="sales.all")
    orders = register("orders", "bigint", "how many orders", group="sales.all")
    spent = register("spent", "double", "the largest order", group="sales.all")
    segment = register("segment", "string", "the market", choices=("AUTOMOBILE", "BUILDING", "MACHINERY"))
    last = register("last", "timestamp", "the day of the last order")
    states = register("states", "array<string>", "the statuses of its orders")
    known.seal()
    of = t.orders.groupBy(F.col("o_custkey").alias("subject"))
    sums = of.agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"), F.max(F.col("o_orderdate").cast("timestamp")).alias("day"), F.array_sort(F.collect_set("o_orderstatus")).alias("states"))
    claims = [
        keys.stamped(sums, active, F.array_contains("states", "O"), "orders")[0], keys.stamped(sums, orders, F.col("n"), "orders")[0], keys.stamped(sums, spent, F.col("most"), "orders")[0],
        keys.stamped(sums, last, F.col("day"), "orders")[0], keys.stamped(sums, states, F.col("states"), "orders")[0],
        keys.stamped(t.customer.where("c_custkey % 4 = 0"), spent, F.col("c_acctbal"), "accounts", subject="c_custkey", authority=1)[0],
    ]
    held, refused = keys.stamped(t.customer, segment, F.col("c_mktsegment"), "accounts", subject="c_custkey")
    found = held
    for c in claims:
        found = found.unionByName(c)
    return found, refused, [active, orders, spent, segment, last, states]


@query("""with o as (select o_custkey as subject, bool_or(o_orderstatus = 'O') as active, count(*) as orders, max(o_totalprice) as most, epoch_ms(max(o_orderdate)) as last, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as states from orders group by 1)
  select c_custkey as subject, active, orders, case when c_custkey % 4 = 0 then c_acctbal else most end as spent, case when c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY') then c_mktsegment end as segment, last, states
  from customer left join o on c_custkey = subject where orders is not null or c_custkey % 4 = 0 or c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""")
def typed_keys(t):
    """The facts that hold on keys of six types, a typed column each."""
    claims, _, known = _typed(t)
    rows = keys.table(facts.winners(claims), known)
    return rows.select("subject", "active", "orders", "spent", "segment", F.unix_millis("last").alias("last"), F.array_join("states", ",").alias("states"))


@query("select c_custkey as subject, 'sales.segment' as key, c_mktsegment as value from customer where c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'MACHINERY')")
def refused_choices(t):
    """Values that are none of their key's choices."""
    return _typed(t)[1]


@query("""select c_custkey, 'func ' || upper(substr(c_mktsegment, 1, 1)) || substr(c_mktsegment, 2) || '(key int64, name string)' as head, '// ' || c_name || chr(10) || '// of ' || c_nationkey as doc,
  '"' || replace(c_name, '"', '\\"') || '"' as literal, 2 as lines from customer""")
def template_functions(t):
    """A text of SQL that calls template functions, among them one of a plugin and a table function."""
    functions = templates.Templates()
    functions.add("signatures", "tpl_func", [("name", "string"), ("params", "string")], "string", "concat('func ', tpl_exported(name), '(', params, ')')")
    functions.register(t.spark)
    return t.spark.sql(
        r"""select c_custkey, tpl_func(c_mktsegment, tpl_params(array('key', 'name'), array('int64', 'string'))) as head, doc, tpl_quote(c_name) as literal, max(l.at) as lines
        from (select *, tpl_comment(concat(c_name, '\n', 'of ', c_nationkey)) as doc from {customer}) c, lateral tpl_lines(doc) l group by all""",
        customer=t.customer,
    )


@query("""select l_orderkey, l_linenumber, l_partkey, cast(octet_length(encode(b)) as bigint) as size, cast(coalesce(sum(octet_length(encode(b))) over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as bigint) as at
  from (select *, case when l_linenumber = 3 then 'é' else '' end || l_partkey || chr(10) as b from lineitem)""")
def plan_output(t):
    """Where every declaration stands in the one output of a plan."""
    body = F.concat(F.when(F.col("l_linenumber") == 3, "é").otherwise(""), F.col("l_partkey").cast("string"), F.lit("\n"))
    rows = emitting_.concatenated(t.lineitem.withColumn("body", body), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "body")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "size", "at")
