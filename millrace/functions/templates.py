"""Functions for texts of SQL: a registry of scalar and table functions, each a SQL expression that the optimizer sees through."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple[tuple[str, str], ...]
    returns: str  # a type, or `table(column type, ...)`
    body: str  # an expression, or a SELECT
    owner: str = "kernel"

    def sql(self) -> str:
        given = ", ".join(f"{n} {t}" for n, t in self.params)
        kind = "RETURNS TABLE" + self.returns[len("table") :] if self.returns.startswith("table") else f"RETURNS {self.returns}"
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({given}) {kind} RETURN {self.body}"


#: What every template can use.
KERNEL = (
    Function("tpl_quote", (("s", "string"),), "string", r"""concat('"', replace(replace(replace(s, '\\', '\\\\'), '"', '\\"'), '\n', '\\n'), '"')"""),
    Function("tpl_indent", (("s", "string"), ("n", "int")), "string", r"""array_join(transform(split(s, '\n', -1), x -> if(x = '', x, concat(repeat('\t', n), x))), '\n')"""),
    Function("tpl_comment", (("s", "string"),), "string", r"""array_join(transform(split(s, '\n', -1), x -> rtrim(concat('// ', x))), '\n')"""),
    Function("tpl_exported", (("s", "string"),), "string", "concat(upper(substring(s, 1, 1)), substring(s, 2))"),
    Function("tpl_params", (("names", "array<string>"), ("types", "array<string>")), "string", "array_join(zip_with(names, types, (n, t) -> concat(n, ' ', t)), ', ')"),
    Function("tpl_lines", (("s", "string"),), "table(at int, line string)", r"SELECT pos + 1, col FROM posexplode(split(s, '\n', -1))"),
)


@dataclass
class Templates:
    """Functions of the kernel and of plugins. A plugin cannot take the name of another's function."""

    functions: dict[str, Function] = field(default_factory=lambda: {f.name: f for f in KERNEL})

    def add(self, owner: str, name: str, params: Sequence[tuple[str, str]], returns: str, body: str) -> Function:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            raise ValueError(f"{name!r} is no name of a function")
        held = self.functions.get(name)
        if held is not None and held.owner != owner:
            raise ValueError(f"{name} is {held.owner}'s")
        self.functions[name] = made = Function(name, tuple(params), returns, body, owner)
        return made

    def register(self, spark: SparkSession) -> None:
        """Make all functions known to the session; a body that does not fit its types is refused here."""
        for f in self.functions.values():
            spark.sql(f.sql())
