"""Typed metadata keys: what a key's values are is registered, and checked when a plan is made.

A value is a struct with one field for each type, of which the key's own is set: such values compare and
group as plain ones do, and a fact table has one column for them all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The types of values and the fields that have them.
FIELDS = {"boolean": "b", "bigint": "l", "double": "d", "string": "s", "timestamp": "t", "array<string>": "a"}
VALUE = f"struct<{','.join(f'{f}:{t}' for t, f in FIELDS.items())}>"
_WIDER = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


@dataclass(frozen=True)
class Key:
    name: str
    type: str
    doc: str
    choices: tuple = ()
    group: str | None = None


@dataclass
class Registry:
    """Namespaces, each of one registrant, and the keys in them. After seal nothing is added."""

    keys: dict[str, Key] = field(default_factory=dict)
    owners: dict[str, str] = field(default_factory=dict)
    sealed: bool = False

    def claim(self, namespace: str, registrant: str) -> None:
        if self.sealed or not namespace or self.owners.get(namespace, registrant) != registrant:
            raise ValueError(f"namespace {namespace!r} is not for {registrant} to claim: " + ("registration has ended" if self.sealed else f"it is {self.owners.get(namespace)}'s" if namespace else "it is empty"))
        self.owners[namespace] = registrant

    def register(self, registrant: str, name: str, kind: str, doc: str, choices: Sequence[str] = (), group: str | None = None) -> Key:
        """A key `namespace.local`. Registering it again, equal in all, gives the same key."""
        namespace, dot, local = name.rpartition(".")
        key, groups = Key(name, kind, doc, tuple(choices), group), {k.group for k in self.keys.values()}
        faults = [
            (self.sealed, "registration has ended"),
            (not (namespace and dot and local), "it has no namespace or no local part"),
            (self.owners.get(namespace) != registrant, f"its namespace is {self.owners.get(namespace)}'s, not {registrant}'s"),
            (kind not in FIELDS, f"{kind} is no type of values"),
            (not doc, "it says nothing on its meaning"),
            (bool(choices) and kind != "string", "only strings have choices"),
            ("" in choices or len(set(choices)) < len(choices), "a choice is empty or repeated"),
            (name in self.keys and self.keys[name] != key, "it is registered with another type or meaning"),
            (name in groups or (group in self.keys), "a key and a group share a name"),
        ]
        if said := [why for fault, why in faults if fault]:
            raise ValueError(f"key {name!r}: {'; '.join(said)}")
        self.keys[name] = key
        return key

    def seal(self) -> Registry:
        self.sealed = True
        return self

    def group(self, name: str) -> list[str]:
        return sorted(k.name for k in self.keys.values() if k.group == name)


def lifted(rows: DataFrame, key: Key, value: Column) -> Column:
    """value as a tagged value of the key. A value of another type is refused here, before a job runs; narrower numbers are widened."""
    found = rows.select(value.alias("v")).dtypes[0][1]
    if _WIDER.get(found, found) != key.type:
        raise TypeError(f"key {key.name!r} takes {key.type}, not {found}")
    return F.when(value.isNotNull(), F.struct(*[(value.cast(t) if t == key.type else F.lit(None).cast(t)).alias(f) for t, f in FIELDS.items()]))


def stamped(rows: DataFrame, key: Key, value: Column, plugin: str, subject: str = "subject", authority: int = 0, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """Claims on the key from rows whose value is not null, and as findings (subject, key, value) those that are none of its choices."""
    tagged = lifted(rows, key, value)
    all_ = rows.select(F.col(subject).alias("subject"), F.lit(key.name).alias("key"), tagged.alias("value"), F.lit(authority).alias("authority"), F.lit(turn).alias("turn"), F.lit(plugin).alias("plugin"), F.lit(0).cast("long").alias("ord")).where("value is not null")
    if not key.choices:
        return all_, all_.limit(0).select("subject", "key", F.col("value.s").alias("value"))
    fits = F.col("value.s").isin(*key.choices)
    return all_.where(fits), all_.where(~fits).select("subject", "key", F.col("value.s").alias("value"))


def read(facts: DataFrame, key: Key) -> DataFrame:
    """subject and value, of the key's own type, of the facts on it."""
    return facts.where(F.col("key") == key.name).select("subject", F.col(f"value.{FIELDS[key.type]}").alias("value"))


def table(facts: DataFrame, keys: Sequence[Key]) -> DataFrame:
    """One row a subject with a typed column for each key, named by its local part; one aggregation."""
    columns = [F.max(F.when(F.col("key") == k.name, F.col(f"value.{FIELDS[k.type]}"))).alias(k.name.rpartition(".")[2]) for k in keys]
    return facts.where(F.col("key").isin(*[k.name for k in keys])).groupBy("subject").agg(*columns)
