"""A composition's fingerprint, kept with its results: any change of rules, keys, schemas or settings makes the next run a cold one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from types import CodeType

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.keys import Registry
from .rules import Plugin


def _code(code: CodeType) -> list:
    return [code.co_code.hex(), list(code.co_names), list(code.co_varnames[: code.co_argcount]), [_code(c) if isinstance(c, CodeType) else repr(c) for c in code.co_consts]]


def _plain(x) -> object:
    """x as JSON that is the same in every process: columns by their expression, functions by their code and what they close over."""
    if isinstance(x, Column):
        return {"column": x._jc.toString() if hasattr(x, "_jc") else str(x)}
    if isinstance(x, Mapping):
        return {"map": sorted((json.dumps(_plain(k)), _plain(v)) for k, v in x.items())}
    if isinstance(x, (set, frozenset)):
        return {"set": sorted(json.dumps(_plain(v)) for v in x)}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if callable(x) and hasattr(x, "__code__"):
        cells = [c.cell_contents for c in x.__closure__ or ()]
        return {"code": _code(x.__code__), "over": [_plain(c) for c in cells if c is not x], "defaults": _plain(x.__defaults__ or ())}
    if hasattr(x, "__dataclass_fields__"):
        return {type(x).__name__: {f: _plain(getattr(x, f)) for f in x.__dataclass_fields__}}
    return repr(x)


def fingerprint(plugins: Sequence[Plugin], keys: Registry, schemas: Mapping[str, DataFrame] | None = None, settings: Mapping | None = None) -> str:
    """A digest of the plugins by name, with their rules in order, of the keys, of the schemas of the tables read, and of settings."""
    parts = {
        "plugins": [_plain(p) for p in sorted(plugins, key=lambda p: p.name)], "keys": _plain(keys.keys), "owners": _plain(keys.owners),
        "schemas": {n: json.loads(d.schema.json()) for n, d in sorted((schemas or {}).items())}, "settings": _plain(settings or {}),
    }
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def resumed(spark: SparkSession, folder: str, mark: str, cold: Callable[[], DataFrame], warm: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """The results of this run, and whether it was a warm one: warm(the last results) where those were written under the same fingerprint, else cold(). They are written for the next run.

    Runs are numbered folders under the fingerprint, and the last one that was written to its end counts,
    so a run that breaks off leaves the one before it.
    """
    fs, top = _file_system(spark, f"{folder}/{mark}")
    done = sorted(int(s.getPath().getName()) for s in fs.listStatus(top) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))) if fs.exists(top) else []
    result = warm(spark.read.parquet(f"{folder}/{mark}/{done[-1]}")) if done else cold()
    path = f"{folder}/{mark}/{done[-1] + 1 if done else 0}"
    result.write.mode("overwrite").parquet(path)
    return spark.read.schema(result.schema).parquet(path), bool(done)
