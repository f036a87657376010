"""Scalar functions, signatures, state and streams over the tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import directives, identity, naming, signatures, text
from ..operators import incremental
from ..sources import state
from ..streaming import watch
from .registry import query

IDENT = "i as (select p_partkey, 'go' as lang, lower(replace(p_brand, '#', '')) || '/' || p_size as package, case when p_size % 3 = 0 then p_type else '' end as owner, case when p_size % 7 = 0 then '' else replace(p_name, ' ', '') end as name, case when p_size % 7 = 0 then 'Package' when p_size % 3 = 0 and p_partkey % 2 = 0 then 'Method' when p_size % 3 = 0 then 'Field' when p_partkey % 2 = 0 then 'Function' when p_size % 5 = 0 then 'File' else 'Struct' end as kind, case when p_partkey % 4 = 0 then 'int,string' else '' end as disc from part)"


def _identities(t):
    size, key = F.col("p_size"), F.col("p_partkey")
    kind = F.when(size % 7 == 0, "Package").when((size % 3 == 0) & (key % 2 == 0), "Method").when(size % 3 == 0, "Field").when(key % 2 == 0, "Function").when(size % 5 == 0, "File").otherwise("Struct")
    return t.part.select(
        "p_partkey", F.lit("go").alias("lang"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), size.cast("string")).alias("package"), F.when(size % 3 == 0, F.col("p_type")).otherwise("").alias("owner"),
        F.when(size % 7 == 0, "").otherwise(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name"), kind.alias("kind"), F.when(key % 4 == 0, "int,string").otherwise("").alias("disc"),
    )


SPELL = "case when kind = 'File' then lang || ':' || package || '/' || name when name = '' then lang || ':' || package else lang || ':' || package || '.' || case when owner <> '' then owner || '#' else '' end || name || case when kind in ('Function', 'Method') then '(' || disc || ')' else '' end end"


def _spelled(t):
    c = [F.col(n) for n in ("lang", "package", "owner", "name", "kind", "disc")]
    return _identities(t).withColumn("text", identity.spelled(*c))


@query(f"with {IDENT} select p_partkey, {SPELL} as text from i")
def identity_spelling(t):
    return _spelled(t).select("p_partkey", "text")


@query(f"with {IDENT} select p_partkey, package, case when name = '' then '' else owner end as owner, name, case when name = '' then 'Package' when kind in ('Function', 'Method') then case when owner <> '' then 'Method' else 'Function' end else '' end as kind, case when kind in ('Function', 'Method') then disc else '' end as disc from i where kind <> 'File'")
def identity_parsing(t):
    return _spelled(t).where("kind <> 'File'").withColumn("p", identity.parsed(F.col("text"))).select("p_partkey", "p.package", "p.owner", "p.name", "p.kind", "p.disc")


@query(f"with {IDENT} select p_partkey, case when owner = '' then name else owner || upper(substr(name, 1, 1)) || substr(name, 2) end as flat from i")
def flat_names(t):
    return _identities(t).select("p_partkey", identity.flat_name(F.col("owner"), F.col("name")).alias("flat"))


@query(f"with {IDENT} select distinct lang, package, 'Package' as kind from i")
def package_identities(t):
    return _identities(t).select(identity.package_identity(F.col("lang"), F.col("package")).alias("p")).select("p.lang", "p.package", "p.kind").distinct()


@query(f"with {IDENT} select p_partkey, cast(list_position(['Function','Method','Param','Return','Package','File','Import','Export','Binding','Enum','EnumVariant','Sum','SumVariant','Field','Variable','Constant','Struct'], kind) as bigint) as ordinal from i")
def kind_ordinals(t):
    return _identities(t).select("p_partkey", identity.kind_ordinal(F.col("kind")).cast("long").alias("ordinal"))


@query("select p_partkey, lower(replace(p_name, ' ', '_')) as snake, lower(replace(p_name, ' ', '-')) as kebab, upper(replace(p_name, ' ', '_')) as screaming from part")
def joined_cases(t):
    names = t.part.select("p_name").distinct().select("p_name", naming.cased(F.col("p_name"), "snake").alias("snake"), naming.cased(F.col("p_name"), "kebab").alias("kebab"), naming.cased(F.col("p_name"), "screaming_snake").alias("screaming"))
    return t.part.join(names, "p_name").select("p_partkey", "snake", "kebab", "screaming")


@query("select p_partkey, array_to_string([upper(substr(w, 1, 1)) || lower(substr(w, 2)) for w in string_split(p_name, ' ')], '') as pascal, lower(string_split(p_name, ' ')[1]) || array_to_string([upper(substr(w, 1, 1)) || lower(substr(w, 2)) for w in string_split(p_name, ' ')[2:]], '') as camel from part")
def title_cases(t):
    names = t.part.select("p_name").distinct().select("p_name", naming.cased(F.col("p_name"), "pascal").alias("pascal"), naming.cased(F.col("p_name"), "camel").alias("camel"))
    return t.part.join(names, "p_name").select("p_partkey", "pascal", "camel")


@query("select p_partkey, cast(len(string_split(p_name, ' ')) as int) as words from part")
def word_counts(t):
    names = t.part.select("p_name").distinct().select("p_name", F.size(naming.words_col(F.col("p_name"))).alias("words"))
    return t.part.join(names, "p_name").select("p_partkey", "words")


@query("select p_partkey, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z_][A-Za-z0-9_]*$') as plain, regexp_matches(p_brand, '^[A-Za-z_][A-Za-z0-9_]*$') as brand from part")
def identifier_test(t):
    return t.part.select("p_partkey", naming.is_identifier(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("plain"), naming.is_identifier(F.col("p_brand")).alias("brand"))


@query("select page_id, concat_ws('_', regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '\\.[^.]*$', ''), 'gen', case when page_id % 2 = 0 then 'test' end) as parts from pages")
def filename_parts(t):
    tag = F.when(F.col("page_id") % 2 == 0, "test").otherwise("")
    return t.pages.select("page_id", F.array_join(naming.filename_parts(F.col("url"), F.lit("gen"), tag), "_").alias("parts"))


@query("with b as (select distinct p_brand as n from part) select a.n as a, b.n as b, damerau_levenshtein(a.n, b.n) as d from b a, b where a.n < b.n")
def edit_distance(t):
    """Between all brands, of which there are 25."""
    n = t.part.select(F.col("p_brand").alias("a")).distinct().withColumn("k", F.lit(1))
    return n.join(n.withColumnRenamed("a", "b"), "k").where("a < b").select("a", "b", naming.distance(F.col("a"), F.col("b")).alias("d"))


@query("select doc_id, '// ' || replace(text, chr(10), chr(10) || '// ') || chr(10) as body from documents")
def line_comments(t):
    return t.documents.select("doc_id", text.line_comments(F.col("text"), "// ").alias("body"))


@query("select doc_id, '/**' || chr(10) || ' * ' || replace(replace(text, '*/', '*\\/'), chr(10), chr(10) || ' * ') || chr(10) || ' */' || chr(10) as body from documents")
def block_comments(t):
    return t.documents.select("doc_id", text.block_comment(F.col("text"), "/**", " * ", " */").alias("body"))


@query("select doc_id, case when text = '' then '' else ' /* ' || replace(replace(replace(text, chr(10), ' '), '*/', '*\\/'), '/*', '/\\*') || ' */' end as body from documents")
def inline_comments(t):
    return t.documents.select("doc_id", text.inline_comment(F.col("text")).alias("body"))


@query(r"select doc_id, case when b = '' then '' else b || chr(10) end as body from (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+\n', chr(10), 'g'), '[ \t\r]+$', ''), '^\n+|\n+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as b from documents) x")
def normalised_text(t):
    return t.documents.select("doc_id", text.normalised(F.col("text")).alias("body"))


@query("select doc_id, array_to_string([trim(x, ' ') for x in string_split(text, chr(10))], ' ') as body from documents")
def folded_lines(t):
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.trim(x), F.lit(" \\")))
    return t.documents.select("doc_id", text.joined(lines).alias("body"))


@query("select event_id, case when event_id % 2 = 0 then '+' else '-' end as mark, event_type || ' k=' || user_id as payload from events where event_id % 3 <> 0")
def carrier_lines(t):
    line = F.concat(F.when(F.col("event_id") % 2 == 0, "  +").otherwise("-"), F.when(F.col("event_id") % 3 == 0, "other:").otherwise("mill:"), F.col("event_type"), F.lit(" k="), F.col("user_id").cast("string"))
    return t.events.select("event_id", text.carrier(line, "mill").alias("c")).where("c is not null").select("event_id", "c.mark", "c.payload")


@query("select event_id, event_type as name, cast(user_id as varchar) as first, 'n=' || cast(event_id as varchar) as second from events")
def directive_parsing(t):
    payload = F.concat(F.col("event_type"), F.lit(' "'), F.col("user_id").cast("string"), F.lit('"   n='), F.col("event_id").cast("string"))
    p = t.events.select("event_id", directives.parsed(payload).alias("d"))
    second = F.col("d.args")[1]
    return p.select("event_id", "d.name", F.col("d.args")[0]["text"].alias("first"), F.concat(second["key"], F.lit("="), second["text"]).alias("second"))


@query("select event_id, case when event_id % 2 = 0 then 'mill' else '' end as plugin, split_part(event_type || '.x.y', '.', 1) as namespace from events")
def name_parts(t):
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "mill:").otherwise(""), F.col("event_type"))
    return t.events.select("event_id", directives.prefix(name).alias("plugin"), directives.namespace(F.concat("event_type", F.lit(".x.y"))).alias("namespace"))


@query("select o_orderkey, case when o_orderkey % 10000 > 0 then 'EID' end as prefix, case when o_orderkey % 10000 > 0 then cast(o_orderkey % 10000 as int) end as number from orders")
def code_parsing(t):
    code = F.concat(F.lit("EID-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return t.orders.select("o_orderkey", identity.code_parts(code).alias("c")).select("o_orderkey", "c.prefix", "c.number")


@query("select l_orderkey, l_linenumber, l_shipmode as file, line, col from (select l_orderkey, l_linenumber, 'f' || l_suppkey || '.go' as l_shipmode, cast(l_partkey as int) as line, l_linenumber as col from lineitem) x")
def position_parsing(t):
    spelled = F.concat(F.lit("f"), F.col("l_suppkey").cast("string"), F.lit(".go:"), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", identity.position_parts(spelled).alias("p")).select("l_orderkey", "l_linenumber", "p.file", "p.line", "p.col")


@query("select o_orderkey, case when o_orderkey - 200 between -128 and 127 then cast(o_orderkey - 200 as bigint) end as i8, case when o_orderkey - 200 between 0 and 255 then cast(o_orderkey - 200 as bigint) end as u8 from orders")
def integer_literals(t):
    spelled = (F.col("o_orderkey") - 200).cast("string")
    return t.orders.select("o_orderkey", text.integer_literal(spelled, "int", 8).cast("long").alias("i8"), text.integer_literal(spelled, "uint", 8).cast("long").alias("u8"))


@query("select event_id, case when event_id % 3 = 0 then true when event_id % 3 = 1 then false end as b from events")
def boolean_literals(t):
    spelled = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("True")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.events.select("event_id", text.boolean_literal(spelled).alias("b"))


@query()
def decimal_spelling(t):
    """Values from tiny to huge, spelled as shortly as they read back."""
    return t.events.select("event_id", text.decimal_text(F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 40 - 15)).alias("spelled"))


@query()
def word_wrap(t):
    return t.documents.select("doc_id", F.array_join(text.wrapped(F.col("text"), 72, text.MARKDOWN), "\n").alias("body"))


@query("select p_partkey, p_brand as json, cast(null as varchar) as yaml from part")
def struct_tags(t):
    tag = F.concat(F.lit('db:"x" json:"'), F.col("p_brand"), F.lit('"'))
    return t.part.select("p_partkey", signatures.tag_value(tag, "json").alias("json"), signatures.tag_value(tag, "yaml").alias("yaml"))


@query("select p_partkey, 'Map[' || p_brand || ', List[' || p_type || ']]' as spelled from part")
def generic_substitution(t):
    bindings = F.create_map(F.lit("K"), F.col("p_brand"), F.lit("V"), F.col("p_type"))
    return t.part.select("p_partkey", signatures.substituted(F.lit("Map[K, List[V]]"), bindings).alias("spelled"))


@query("select o_custkey, string_agg(distinct left(o_orderpriority, 1), ',' order by left(o_orderpriority, 1)) as mentioned from orders where left(o_orderpriority, 1) in ('1', '2', '3') group by o_custkey")
def mentioned_params(t):
    used = t.orders.groupBy("o_custkey").agg(F.collect_set(F.left("o_orderpriority", F.lit(1))).alias("names"))
    params = F.array(F.lit("1"), F.lit("2"), F.lit("3"))
    return used.select("o_custkey", F.array_join(signatures.mentioned(params, F.col("names")), ",").alias("mentioned")).where("mentioned <> ''")


SIG = """s as (select l_orderkey, l_linenumber, l_partkey % 4 as inputs, l_suppkey % 4 as vals, l_returnflag = 'R' as fails, l_linestatus = 'O' as has_ctx, l_linenumber = 3 as variadic,
  ['Named', 'List', 'Interface', 'Scalar'][cast(l_partkey % 16 / 4 as int) % 4 + 1] as first_form, ['Bool', 'List', 'Optional', 'Named'][cast(l_suppkey // 4 % 4 as int) + 1] as value_form, l_quantity > 45 as stream, case when l_quantity < 10 then 'Close' when l_quantity < 20 then 'remove' else 'Run' end as name, l_quantity > 25 as same from lineitem)"""


def _signatures(t):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    c = F.col
    value_form = pick(("Bool", "List", "Optional", "Named"), F.floor(c("l_suppkey") / 4) % 4)
    inputs, values = (c("l_partkey") % 4).alias("inputs"), (c("l_suppkey") % 4).alias("values")
    fails, ctx = c("l_returnflag") == "R", c("l_linestatus") == "O"
    typed = F.when(c("l_quantity") > 25, "T").otherwise("")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", inputs, values, fails.alias("fails"), ctx.alias("has_ctx"), (inputs + ctx.cast("int")).alias("n_params"), (values + F.when(fails, 1).otherwise(0)).alias("n_returns"),
        pick(("Named", "List", "Interface", "Scalar"), F.floor(c("l_partkey") % 16 / 4) % 4).alias("first_form"), (c("l_linenumber") == 3).alias("first_variadic"), value_form.alias("value_form"),
        F.when(~fails & (values > 0), value_form).otherwise("Named").alias("last_form"), typed.alias("first_type"), typed.alias("value_type"), (c("l_quantity") > 45).alias("stream"),
        F.when(c("l_quantity") < 10, "Close").when(c("l_quantity") < 20, "remove").otherwise("Run").alias("name"),
    )


@query("""with s0 as (select l_orderkey, l_linenumber, l_partkey % 4 as i, l_suppkey % 4 as v, l_returnflag = 'R' as f, l_linestatus = 'O' as c, l_linenumber = 3 as va, ['Named', 'List', 'Interface', 'Scalar'][cast(l_partkey % 16 // 4 as int) + 1] as ff, ['Bool', 'List', 'Optional', 'Named'][cast(l_suppkey // 4 % 4 as int) + 1] as vf, l_quantity > 45 as st, case when l_quantity < 10 then 'close' when l_quantity < 20 then 'remove' else 'run' end as n, l_quantity > 25 as same from lineitem),
s as (select *, i + case when c then 1 else 0 end as np, v + case when f then 1 else 0 end as nr, case when not f and v > 0 then vf else 'Named' end as lf from s0)
select l_orderkey, l_linenumber, case when f and i = 1 and va and v = 1 and vf in ('List', 'Bytes') then 'BatchReader' when f and np = 0 and v = 0 and n = 'close' then 'Closer' when f and i = 2 and v = 0 then 'CompositeWriter' when f and i = 1 and v = 0 and n = 'remove' then 'Deleter' when c and f and i = 0 and v = 0 then 'Lifecycle' when i = 1 and nr = 3 and lf = 'Bool' then 'Lookup' when f and i = 0 and v >= 2 then 'MultiAggregator' when f and i >= 3 and v = 0 then 'MultiArgWriter' when f and i = 1 and v >= 2 then 'MultiReader' when not f and i = 1 and nr = 0 then 'Mutator' when f and np = 0 and v = 0 then 'PoisonAccessor' when np = 0 and nr = 1 and lf = 'Bool' then 'Predicate' when i = 1 and nr = 2 and lf = 'Bool' then 'ReaderWithBool' when c and f and i = 1 and v = 1 and ff = 'Interface' then 'StreamConsumer' when f and i = 1 and v = 1 and same then 'AnsweringWriter' when f and i = 1 and v = 1 and ff not in ('List', 'Interface') then 'Reader' when i <= 1 and nr = 1 and st then 'StreamReader' when not c and not f and nr = 1 then 'Computation' when i = 0 and v = 1 then 'Aggregator' when not f and i = 1 and nr = 1 and vf = 'Optional' then 'PointerReader' when not f and i = 1 and not va and nr = 1 and v = 1 and not st then 'ReaderNoError' when np = 0 and nr = 0 and not f then 'VoidLifecycle' when f and i = 1 and v = 0 then 'Writer' end as shape from s""")
def shape_detection(t):
    return _signatures(t).select("l_orderkey", "l_linenumber", signatures.shape().alias("shape"))


FORM = "['Bool', 'Scalar', 'Text', 'List', 'Named'][cast(p_size % 5 as int) + 1]"


def _form():
    return F.element_at(F.array(*[F.lit(x) for x in ("Bool", "Scalar", "Text", "List", "Named")]), (F.col("p_size") % 5 + 1).cast("int"))


@query(f"select p_partkey, case {FORM} when 'Bool' then 'true' when 'Scalar' then '1' when 'Text' then '\"' || p_brand || '\"' end as sample, case {FORM} when 'Bool' then 'false' when 'Scalar' then '2' when 'Text' then '\"' || p_brand || '2\"' end as alternate from part")
def sample_values(t):
    return t.part.select("p_partkey", signatures.sample_pair(_form(), F.col("p_brand")).alias("s")).select("p_partkey", "s.sample", "s.alternate")


@query(f"select p_partkey, case {FORM} when 'Bool' then 'false' when 'Scalar' then '0' when 'Text' then '\"\"' when 'List' then 'nil' end as zero from part")
def zero_values(t):
    return t.part.select("p_partkey", signatures.zero_value(_form()).alias("zero"))


@query("select p_partkey, case when p_size % 2 = 0 then p_brand else 'a' end as sample, case when p_size % 2 = 0 then 'a' else 'b' end as alternate from part")
def completed_pairs(t):
    authored = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    pair = signatures.completed(authored, F.lit(None).cast("string"), F.lit("a"), F.lit("b"))
    fixed = F.when(F.col("p_size") % 2 == 0, F.struct(pair["sample"].alias("sample"), F.lit("a").alias("alternate"))).otherwise(pair)
    return t.part.select("p_partkey", fixed.alias("p")).select("p_partkey", "p.sample", "p.alternate")


@query("select p_partkey, 'Err' || p_brand as name, p_type || ',' || p_brand as disc from part")
def spelled_names(t):
    return t.part.select("p_partkey", signatures.sentinel_name(F.col("p_brand")).alias("name"), signatures.overload_key(F.array(F.concat(F.lit(" "), F.col("p_type")), F.col("p_brand"))).alias("disc"))


def _folder(t) -> str:
    return f"{incremental.shared_folder(t.spark)}/state-{uuid.uuid4().hex}"


@query("select o_orderkey as key, case when o_orderkey % 10 = 3 then 'new' else o_orderstatus end as value from orders where o_orderkey % 10 not in (0, 1) union all select o_orderkey + 100000000, 'added' from orders where o_orderkey % 100 = 7")
def state_generations(t):
    """Three generations of a table: a first run, changes, and removals."""
    store = state.Store(t.spark, _folder(t))
    o = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), F.lit(False).alias("dead"))
    store.commit({"orders": o.where("key % 10 <> 0")})
    added = o.where("key % 100 = 7").withColumn("key", F.col("key") + 100000000).withColumn("value", F.lit("added"))
    store.commit({"orders": o.where("key % 10 = 3").withColumn("value", F.lit("new")).unionByName(added)})
    store.commit({"orders": o.where("key % 10 = 1").withColumn("dead", F.lit(True))})
    return store.table("orders").select("key", "value")


@query("select url as path, page_id from pages")
def manifest_shards(t):
    folder = _folder(t)
    state.write_manifest(t.pages.select(F.col("url").alias("path"), "page_id"), folder)
    return state.read_manifest(t.spark, folder, T.StructType([T.StructField("path", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("bucket", T.StringType())]))


@query("select o_orderkey as path, o_orderstatus as digest from orders where o_orderkey % 3 <> 0 and (o_orderkey % 3 = 1 or o_orderkey % 5 = 0) and o_orderkey % 9 <> 2")
def disk_commit(t):
    """What is written: staged rows that are new or differ, but not over files of others."""
    o = t.orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("digest"))
    found = o.where("path % 3 <> 1").withColumn("own", F.col("path") % 9 != 2).withColumn("digest", F.when(F.col("path") % 5 == 0, "X").otherwise(F.col("digest")))
    return state.to_write(o.where("path % 3 <> 0"), found, owned="own").select("path", "digest")


@query("select user_id as key, event_id as id, event_type as value from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events) x where before is null or before <> event_type")
def stream_changes(t):
    """The events as a stream: those whose type differs from the user's last, in order of arrival. Here all files arrive at once."""
    folder, events = _folder(t), t.events.select("event_id", "user_id", "event_type")
    events.write.parquet(f"{folder}/in")
    out: list = []

    def keep(batch, number: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/out")
        out.append(number)

    stream = t.spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    changed = watch.report_changes(stream)
    changed.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("key long, id long, value string").parquet(f"{folder}/out")


@query("""with k as (select min(p_type) as kind from part), s as (select p_partkey as subject, p_size from part, k where p_type = kind and p_size > 3 and p_size <> 7)
  select subject, 'size' as key, cast(p_size as varchar) as value, 0 as authority, 0 as turn, 'sizes' as plugin, cast(0 as bigint) as ord from s
  union all select l_partkey, 'marked', cast(l_orderkey as varchar), 1, 1, 'marks', l_orderkey from lineitem join s on subject = l_partkey where l_quantity > 45 and l_returnflag <> 'R'""")
def rule_dispatch(t):
    """Two plugins over parts: one classifies, the next runs where the first left a fact."""
    from .rules import CLAIMS, Plugin, condition, gated, has_key, on, run, where

    symbols = t.part.select(F.col("p_partkey").alias("subject"), F.col("p_type").alias("kind"), F.col("p_brand").alias("name"), "p_size")
    kind = t.part.agg(F.min("p_type")).first()[0]
    empty = t.spark.createDataFrame([], CLAIMS)
    marks = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("subject"), F.lit("mark").alias("name"), F.col("l_orderkey").alias("instance"), (F.col("l_returnflag") == "R").alias("negated"))
    skips = t.part.where("p_size = 7").select(F.col("p_partkey").alias("subject"), F.lit(None).cast("string").alias("plugin"))

    def sized(frames):
        for rows in frames:
            yield pd.DataFrame({"subject": rows["subject"], "key": "size", "value": rows["p_size"].astype(str), "authority": 0, "turn": 0, "plugin": "sizes", "ord": rows["instance"]})

    def marked(rows):
        return rows.select("subject", F.lit("marked").alias("key"), F.col("instance").cast("string").alias("value"), F.lit(1).alias("authority"), F.lit(1).alias("turn"), F.lit("marks").alias("plugin"), F.col("instance").cast("long").alias("ord"))

    first = Plugin("sizes").handle(where(condition(F.col("p_size") > 3), on(kind, sized, CLAIMS)))
    second = Plugin("marks", requires=["sizes"]).handle(where(has_key("size"), *gated("mark", on(kind, marked))))
    return run([second, first], symbols, empty, marks, skips)
