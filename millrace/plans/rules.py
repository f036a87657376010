"""Plugins: handlers behind gates, registered by name and run as DataFrame plans.

A rule is a kind, gates, and a handler. Gates become filters and semi-joins, which Catalyst pushes to
the scan; handlers take an iterator of pandas frames and yield frames of claims or outputs, through
mapInPandas, or are functions from a DataFrame to a DataFrame, which stay inside Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import facts, gates
from ..operators.incremental import cut

CLAIMS = "subject long, key string, value string, authority int, turn int, plugin string, ord long"
OUTPUTS = "family string, tag string, dest string, subject long, body string"


@dataclass(frozen=True)
class Rule:
    kind: str
    handler: Callable
    schema: str | None = None  # of what an iterator handler yields; None: the handler maps DataFrames
    directive: str | None = None
    has: tuple = ()
    equals: tuple = ()
    lacks: tuple = ()
    where: tuple = ()
    out: tuple = ()  # kinds that the handler emits, for rules that run in stages


def on(kind: str, handler: Callable, schema: str | None = None) -> Rule:
    return Rule(kind, handler, schema)


def gated(name: str, *rules: Rule) -> list[Rule]:
    """One match for each instance of the directive."""
    return [replace(r, directive=name) for r in rules]


def where(gate: tuple, *rules: Rule) -> list[Rule]:
    """rules behind one more gate: has_key, key_equals, lacks_key or condition."""
    name, value = gate
    return [replace(r, **{name: (*getattr(r, name), value)}) for r in rules]


def has_key(key: str) -> tuple:
    return "has", key


def key_equals(key: str, value) -> tuple:
    return "equals", (key, value)


def lacks_key(key: str) -> tuple:
    return "lacks", key


def condition(column: Column) -> tuple:
    return "where", column


def name_equals(name: str) -> tuple:
    return condition(F.col("name") == name)


def has_slot(slot: str) -> tuple:
    return condition(F.array_contains("slots", slot))


def negated(gate: tuple) -> tuple:
    """The opposite of a gate; an absent fact fulfils it."""
    kind, value = gate
    if kind == "where":
        return condition(~F.coalesce(value, F.lit(False)))
    if kind == "equals":
        raise ValueError("negate a condition on a joined value instead")
    return ("lacks" if kind == "has" else "has"), value


@dataclass
class Plugin:
    name: str
    rules: list[Rule] = field(default_factory=list)
    requires: Sequence[str] = ()

    def handle(self, *rules: Rule | list[Rule]) -> Plugin:
        for r in rules:
            self.rules += r if isinstance(r, list) else [r]
        return self


def matches(rule: Rule, plugin: str, symbols: DataFrame, holding: DataFrame, directives: DataFrame, skips: DataFrame) -> DataFrame:
    """The subjects a rule runs on, one row a match: by kind, opt-outs, then predicates. Directive-gated rules are exempt from skips."""
    rows = gates.by_kind(symbols, rule.kind)
    if rule.directive is not None:
        rows = gates.gated(rows, directives.where(F.col("name") == rule.directive).select("subject", "instance", "negated"))
    else:
        rows = gates.not_skipped(rows.withColumn("plugin", F.lit(plugin)), skips).drop("plugin").withColumn("instance", F.lit(0))
    for c in rule.where:
        rows = rows.where(c)
    for key in rule.has:
        rows = gates.has_key(rows, holding, key)
    for key, value in rule.equals:
        rows = gates.key_equals(rows, holding, key, value)
    for key in rule.lacks:
        rows = gates.lacks_key(rows, holding, key)
    return rows


def run(plugins: Sequence[Plugin], symbols: DataFrame, claims: DataFrame, directives: DataFrame, skips: DataFrame) -> DataFrame:
    """Claims after all plugins ran in order of what they require; each sees the winners that those before it left."""
    left, done = list(plugins), set()
    while left:
        ready = [p for p in left if set(p.requires) <= done]
        if not ready:
            raise ValueError(f"plugins require each other: {[p.name for p in left]}")
        holding = facts.winners(claims)
        fresh = []
        for p in ready:
            for rule in p.rules:
                rows = matches(rule, p.name, symbols, holding, directives, skips)
                fresh.append(rule.handler(rows) if rule.schema is None else rows.mapInPandas(rule.handler, rule.schema))
            done.add(p.name)
            left.remove(p)
        for f in fresh:
            claims = claims.unionByName(f.select(*claims.columns))
    return claims


def selected_plans(wanted: Sequence[str], needs: dict[str, Sequence[str]]) -> list[str]:
    """The wanted plans and all that they depend on, those first that others need."""
    out: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"plans depend on each other: {' -> '.join((*path, name))}")
        if name not in out:
            for n in needs.get(name, ()):
                visit(n, (*path, name))
            out.append(name)

    for name in wanted:
        visit(name, ())
    return out


#: The kinds of declarations that rules are for (fixed values).
KINDS = ("struct", "interface", "enum", "variant", "sum", "alias", "function", "method", "field", "param", "return", "variable", "constant")


def emits(*columns: Column, when: Column | None = None) -> Callable:
    """A handler that stays in Spark: for each match one row of these columns, or none where `when` does not hold."""

    def handler(condition: Column) -> Column:
        return F.when(condition if when is None else condition & F.coalesce(when, F.lit(False)), F.struct(*columns))

    handler.columns = columns
    return handler


def _held(gate: Column) -> Column:
    return F.coalesce(gate, F.lit(False))


def _instances(directive: str, number: int) -> Column:
    """A match of the rule of that number for each instance of the directive on the subject."""
    own = F.filter(F.coalesce("_marks", F.array().cast("array<struct<name:string,instance:long>>")), lambda m: m["name"] == directive)
    return F.transform(own, lambda m: F.struct(F.lit(number).alias("rule"), m["instance"].cast("long").alias("instance")))


def matched(rules: Sequence[tuple[str, Rule]], symbols: DataFrame, holding: DataFrame, directives: DataFrame, skips: DataFrame) -> DataFrame:
    """One row a match of any of the rules (plugin, rule): the symbol, rule (its number) and instance. See dispatched.

    The symbols are scanned once, whatever the number of rules. What gates ask of a subject stands in one
    row for it: its facts, its directives, and who it has opted out of.
    """
    facts_of = holding.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_facts"))
    named = {r.directive for _, r in rules if r.directive is not None}
    marks = directives.where(F.col("name").isin(*named) & ~F.col("negated")).groupBy("subject").agg(F.collect_list(F.struct("name", "instance")).alias("_marks")) if named else None
    off = skips.groupBy("subject").agg(F.collect_set(F.coalesce("plugin", F.lit("*"))).alias("_off"))
    rows = symbols.where(F.col("kind").isin(*{r.kind for _, r in rules})).join(facts_of, "subject", "left").join(off, "subject", "left")
    rows = rows.join(marks, "subject", "left") if marks is not None else rows.withColumn("_marks", F.lit(None).cast("array<struct<name:string,instance:long>>"))
    tests = []
    for k, (plugin, rule) in enumerate(rules):
        ok = F.col("kind") == rule.kind
        for c in rule.where:
            ok = ok & _held(c)
        for key in rule.has:
            ok = ok & _held(F.map_contains_key("_facts", key))
        for key, value in rule.equals:
            ok = ok & _held(F.try_element_at("_facts", F.lit(key)) == value)
        for key in rule.lacks:
            ok = ok & ~_held(F.map_contains_key("_facts", key))
        none = F.array().cast("array<struct<rule:int,instance:long>>")
        if rule.directive is None:
            ok = ok & ~_held(F.arrays_overlap("_off", F.array(F.lit("*"), F.lit(plugin))))
            found = F.array(F.struct(F.lit(k).alias("rule"), F.lit(0).cast("long").alias("instance")))
        else:
            found = _instances(rule.directive, k)
        tests.append(F.when(ok, found).otherwise(none))
    return rows.withColumn("_m", F.explode(F.concat(*tests))).select(*symbols.columns, "_facts", "_m.rule", "_m.instance")


def dispatched(plugins: Sequence[Plugin], symbols: DataFrame, holding: DataFrame, directives: DataFrame, skips: DataFrame, schema: str, kinds: Sequence[str] = KINDS) -> DataFrame:
    """plugin and rows of schema from all rules of the plugins, of whatever kinds, in one pass over symbols.

    symbols: subject, kind, and what gates and handlers read. holding: the facts that hold (subject, key,
    value). directives: subject, name, instance, negated. skips: subject, plugin (null: all). A rule of a
    directive runs once an instance that is not negated, and skips are no matter to it. Handlers made by
    `emits` become Spark expressions; others take an iterator of pandas frames of their matches, with
    the instance, and yield frames of schema, all of them in one pass of Arrow batches. A rule without
    matches gives no rows, and so do empty tables.
    """
    rules = [(p.name, r) for p in plugins for r in p.rules]
    odd = [p for p, r in rules if r.kind not in kinds]
    if odd:
        raise ValueError(f"rules for kinds that do not exist: {odd}")
    rows = matched(rules, symbols, holding, directives, skips)
    names = F.array(*[F.lit(p) for p, _ in rules])[F.col("rule")].alias("plugin")
    plain = [k for k, (_, r) in enumerate(rules) if hasattr(r.handler, "columns")]
    frames = [k for k in range(len(rules)) if k not in plain]
    target = symbols.sparkSession.createDataFrame([], schema)
    out = []
    if plain:
        made = F.coalesce(*[rules[k][1].handler(F.col("rule") == k).cast(f"struct<{','.join(f'{c}:{t}' for c, t in target.dtypes)}>") for k in plain])
        out.append(rows.where(F.col("rule").isin(*plain)).select(names, made.alias("_row")).where("_row is not null").select("plugin", "_row.*"))
    if frames:
        handlers, owner = {k: rules[k][1].handler for k in frames}, {k: rules[k][0] for k in frames}
        columns = target.columns

        def run(batches):
            for batch in batches:
                for k, part in batch.groupby("rule"):
                    for made in handlers[k](iter([part.drop(columns="rule").reset_index(drop=True)])):
                        yield made[columns].assign(plugin=owner[k])

        out.append(rows.where(F.col("rule").isin(*frames)).drop("_facts").mapInPandas(run, f"{schema}, plugin string").select("plugin", *columns))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def staged(plugins: Sequence[Plugin], symbols: DataFrame, holding: DataFrame, directives: DataFrame, skips: DataFrame, schema: str, stages: int = 8) -> DataFrame:
    """stage, plugin and the rows that rules emit, where rules can match what was emitted in an earlier stage.

    schema: of emitted rows, with subject (their origin), kind and what rules read. In stage 1 rules match
    symbols; in each later one they match what the stage before emitted, by its kind, while gates read the
    facts, directives and skips of its origin. A kind that leads back to itself, by what its rules state
    that they emit (Rule.out), is refused before anything runs; so is a chain of more stages than given.
    """
    rules = [(p.name, r) for p in plugins for r in p.rules]
    leads: dict[str, set] = {}
    for name, r in rules:
        if not r.out:
            raise ValueError(f"a rule of {name} does not state which kinds it emits")
        leads.setdefault(r.kind, set()).update(r.out)
    depth: dict[str, int] = {}

    def chain(kind: str, path: tuple[str, ...]) -> int:
        if kind in path:
            raise ValueError(f"rules feed themselves: {' -> '.join((*path[path.index(kind) :], kind))}")
        if kind not in depth:
            depth[kind] = 1 + max((chain(k, (*path, kind)) for k in leads[kind]), default=0) if kind in leads else 0
        return depth[kind]

    longest = max((chain(r.kind, ()) for _, r in rules), default=0)
    if longest > stages:
        raise ValueError(f"rules emit through {longest} stages; {stages} are allowed")
    out, now = [], symbols
    for stage in range(1, longest + 1):
        now = cut(dispatched(plugins, now, holding, directives, skips, schema, [r.kind for _, r in rules]))
        out.append(now.select(F.lit(stage).alias("stage"), *now.columns))
        now = now.drop("plugin")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def emitting(kinds: Sequence[str], *rules: Rule) -> list[Rule]:
    """rules, which state that they emit these kinds."""
    return [replace(r, out=tuple(kinds)) for r in rules]
