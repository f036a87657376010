"""Facts over the tables: lineitem holds the claims, orders the tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, gates, incremental, lineage
from .registry import Tables, query

CL = """c as (select l_orderkey as subject, l_returnflag as key, l_partkey as value,
  case when l_discount >= 0.08 then 2 when l_discount >= 0.04 then 1 else 0 end as authority,
  l_linenumber as turn, l_suppkey as plugin, l_quantity as ord from lineitem)"""
W = "row_number() over (partition by subject, key order by authority desc, turn, plugin, ord, value)"
WIN = f"w as (select * from (select c.*, {W} as rn from c) x where rn = 1)"


def claims(t: Tables) -> DataFrame:
    authority = F.when(F.col("l_discount") >= 0.08, 2).when(F.col("l_discount") >= 0.04, 1).otherwise(0)
    return t.lineitem.select(
        F.col("l_orderkey").alias("subject"), F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("value"), authority.alias("authority"),
        F.col("l_linenumber").alias("turn"), F.col("l_suppkey").alias("plugin"), F.col("l_quantity").alias("ord"),
    )


def even(c: DataFrame) -> DataFrame:
    return facts.withdrawn(c, (F.col("authority") == 2) & (F.col("plugin") % 2 == 0))


@query(f"with {CL}, {WIN} select subject, key, value, authority from w")
def claim_winner(t):
    return facts.winners(claims(t)).select("subject", "key", "value", "authority")


@query(f"with {CL} select subject, key, value, cast({W} as int) as rank from c")
def claims_of_facts(t):
    return facts.ranked(claims(t)).select("subject", "key", "value", "rank")


@query(f"with {CL}, {WIN} select subject, key, value from w where authority >= 1")
def authority_floor(t):
    return facts.winners_at_least(claims(t), 1).select("subject", "key", "value")


@query(f"with {CL} select subject, key, authority, turn, plugin, count(distinct value) as n from c group by all having count(distinct value) > 1")
def claim_conflict(t):
    return facts.conflicts(claims(t).withColumn("ord", F.lit(0))).drop("ord")


@query(f"""with {CL}, d as (select distinct * from c) select subject, key, count(*) as n from d
where (subject, key, authority, turn, plugin, ord) not in (select (subject, key, authority, turn, plugin, ord) from c group by subject, key, authority, turn, plugin, ord having count(distinct value) > 1) group by subject, key""")
def claims_admitted(t):
    return facts.admitted(claims(t)).groupBy("subject", "key").agg(F.count("*").alias("n"))


@query(f"with {CL.replace('c as', 'c0 as', 1)}, c as (select * from c0 where not (authority = 2 and plugin % 2 = 0)), {WIN} select subject, key, value from w")
def withdraw_rerank(t):
    return facts.winners(even(claims(t))).select("subject", "key", "value")


@query(f"with {CL.replace('c as', 'c0 as', 1)}, c as (select * from c0 where plugin not in (select s_suppkey from supplier where s_acctbal < 0)), {WIN} select subject, key, value from w")
def withdraw_plugins(t):
    gone = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("plugin"))
    return facts.winners(facts.withdrawn_sources(claims(t), gone, ["plugin"])).select("subject", "key", "value")


@query(f"""with {CL}, {WIN}, t as (select o_orderkey as subject, case when o_orderpriority like '1%' then 2 when o_orderpriority like '2%' then 1 else 0 end as ta, 3 as tt, 50 as tp, 0.0 as tord from orders where o_orderstatus = 'F')
select w.subject, w.key, w.value from w left join t on t.subject = w.subject
where t.subject is null or not (ta > authority or (ta = authority and (tt < turn or (tt = turn and (tp < plugin or (tp = plugin and tord < ord))))))""")
def group_tombstone(t):
    drops = t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("subject"), F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(0).alias("authority"),
        F.lit(3).alias("turn"), F.lit(50).cast("long").alias("plugin"), F.lit(0.0).alias("ord"),
    )
    return facts.present(facts.winners(claims(t)), drops).select("subject", "key", "value")


@query(f"""with {CL}, {WIN} select w.subject, w.key, w.value from w left join orders o on o.o_orderkey = w.subject and o.o_orderstatus = 'O' and w.key in ('A', 'N')
where o.o_orderkey is null or not (1 > authority or (1 = authority and (2 < turn or (2 = turn and (10 < plugin or (10 = plugin and 0 < ord))))))""")
def key_group_drop(t):
    drops = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("subject"), F.lit("open").alias("group"), F.lit(1).alias("authority"), F.lit(2).alias("turn"), F.lit(10).cast("long").alias("plugin"), F.lit(0.0).alias("ord"))
    groups = t.spark.createDataFrame([("open", "A"), ("open", "N")], "group string, key string")
    return facts.present(facts.winners(claims(t)), drops, groups).select("subject", "key", "value")


@query(f"with {CL}, {WIN} select o.o_orderkey as subject, w.value from orders o left join w on w.subject = o.o_orderkey and w.key = 'R'")
def fact_read(t):
    return facts.read(t.orders.select(F.col("o_orderkey").alias("subject")), facts.winners(claims(t)), "R")


@query(f"with {CL} select distinct subject from c where key = 'A'")
def subjects_of_key(t):
    return facts.subjects_of(facts.winners(claims(t)), "A")


@query("select distinct 'audit' as record, 'fact' as grain, o_orderkey as subject, 'R' as key from orders where o_orderstatus = 'P'")
def tracked_reads(t):
    return facts.tracked(t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("subject")), facts.winners(claims(t)), "R", "audit")[1]


@query(f"with {CL} select distinct subject, key from c where plugin = 7")
def claimed_by_plugin(t):
    return facts.claimed_by(claims(t), 7)


OVERLAY = f"{CL.replace('c as', 'c0 as', 1)}, c as (select * from c0 where subject % 3 <> 0 union all select subject, key, value, 2, turn, plugin, ord from c0 where subject % 3 = 0 and turn = 1)"


@query(f"with {OVERLAY}, {WIN} select subject, key, value, authority from w")
def claims_overlay(t):
    c = claims(t)
    fresh = c.where("subject % 3 = 0 and turn = 1").withColumn("authority", F.lit(2))
    return facts.winners(facts.overlaid(c, fresh, c.where("subject % 3 = 0"))).select("subject", "key", "value", "authority")


@query(f"""with {CL}, b as (select * from (select c.*, {W} as rn from c) x where rn = 1), a as (select * from (select c.*, {W} as rn from c where not (authority = 2 and plugin % 2 = 0)) x where rn = 1)
select coalesce(b.subject, a.subject) as subject, coalesce(b.key, a.key) as key from b full outer join a on a.subject = b.subject and a.key = b.key where a.value is distinct from b.value""")
def early_cutoff(t):
    c = claims(t)
    return facts.cutoff(facts.winners(c), facts.winners(even(c)))


@query(f"with {CL}, {WIN} select subject, max(case when key = 'A' then value end) as a, max(case when key = 'N' then value end) as n, max(case when key = 'R' then value end) as r from w group by subject")
def read_classification(t):
    return facts.classification(facts.winners(claims(t)), ["A", "N", "R"]).select("subject", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("select c_custkey as subject, 'tier' as key, case when c_acctbal > 5000 then 'gold' else 'plain' end as value, 1 as authority, 0 as turn, 'tiers' as plugin, 0 as ord from customer")
def stamped_claims(t):
    return facts.stamped(t.customer, "tier", F.when(F.col("c_acctbal") > 5000, "gold").otherwise("plain"), "tiers", subject="c_custkey", authority=1)


@query(f"with {OVERLAY}, {WIN} select subject, key, value from w")
def warm_run(t):
    """The touched third runs again; the rest is kept. Equal to claims_overlay from scratch."""
    c = claims(t)
    run = lambda rows: rows.where("turn = 1").withColumn("authority", F.lit(2))
    return incremental.warm_winners(c, c, c.where("subject % 3 = 0"), run)[0].select("subject", "key", "value")


@query(f"with {CL} select subject, key, value, cast({W} as int) as rank from c where subject = 15 and key = 'R'")
def explain_fact(t):
    return lineage.explain_fact(claims(t), 15, "R").select("subject", "key", "value", "rank")


@query(f"with {CL}, {WIN} select o_orderkey as subject from orders where o_orderkey in (select subject from w where key = 'R')")
def has_key(t):
    return gates.has_key(t.orders.select(F.col("o_orderkey").alias("subject")), facts.winners(claims(t)), "R")


@query(f"with {CL}, {WIN} select o_orderkey as subject from orders where o_orderkey in (select subject from w where key = 'N' and value = 25)")
def key_equals(t):
    return gates.key_equals(t.orders.select(F.col("o_orderkey").alias("subject")), facts.winners(claims(t)), "N", 25)


@query(f"with {CL}, {WIN} select o_orderkey as subject from orders where o_orderkey not in (select subject from w where key = 'R')")
def lacks_key(t):
    return gates.lacks_key(t.orders.select(F.col("o_orderkey").alias("subject")), facts.winners(claims(t)), "R")
