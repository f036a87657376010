"""The grammar of directives: `name arg key=value key=[a, "b c"]`."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_IDENT = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_BARE = re.compile(r"[^ \t=,\[\]\"]+")
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t"}

SCHEMA = "name string, args array<struct<key: string, text: string, quoted: boolean, list: string, col: int>>, error string"


class Refused(ValueError):
    """A payload outside the grammar; at is the place where reading stopped."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(f"offset {at}: {why}")
        self.at = at


class _Reader:
    def __init__(self, payload: str) -> None:
        self.s, self.at = payload, 0

    def take(self, pattern: re.Pattern, why: str) -> str:
        m = pattern.match(self.s, self.at)
        if not m:
            raise Refused(self.at, why)
        self.at = m.end()
        return m[0]

    def next(self) -> str:
        return self.s[self.at : self.at + 1]

    def blanks(self) -> bool:
        begin = self.at
        while self.next() in (" ", "\t"):
            self.at += 1
        return self.at > begin

    def value(self):
        """(text, quoted) for a scalar, a list for a list."""
        if self.next() == '"':
            return self.quoted(), True
        if self.next() != "[":
            return self.take(_BARE, "a value is a list, a quoted string or a bare spelling"), False
        self.at += 1
        out: list = []
        if self.next() == "]":
            self.at += 1
            return out
        while True:
            out.append(self.value())
            end = self.next()
            if end not in (",", "]") or not end:
                raise Refused(self.at, "a list element ends with a comma or a bracket")
            self.at += 1
            if end == "]":
                return out
            self.blanks()

    def quoted(self) -> str:
        self.at += 1
        out = ""
        while c := self.next():
            self.at += 1
            if c == '"':
                return out
            if c == "\\":
                e = self.next()
                if not e:
                    break
                if e not in _ESCAPES:
                    raise Refused(self.at - 1, "an escape is one of \\\" \\\\ \\n \\t")
                self.at += 1
                c = _ESCAPES[e]
            out += c
        raise Refused(self.at, "a quoted value is unterminated")


def parse(payload: str) -> tuple[str, list[tuple]]:
    """The name and the arguments (key, value, place) in their order; key is empty for a positional one."""
    r = _Reader(payload)
    r.blanks()
    name = r.take(_IDENT, "a directive name starts with a letter")
    if r.next() == ":":
        r.at += 1
        name += ":" + r.take(_IDENT, "a directive name after its prefix starts with a letter")
    args = []
    while r.next():
        if not r.blanks():
            raise Refused(r.at, "an argument follows white space")
        if not r.next():
            break
        at, key = r.at, ""
        m = _IDENT.match(r.s, r.at)
        if m and r.s[m.end() : m.end() + 1] == "=":
            key, r.at = m[0], m.end() + 1
        elif r.next() == "=":
            raise Refused(r.at, "an argument does not start with an equals sign")
        args.append((key, r.value(), at))
    return name, args


def cut(payload: str, opens: Callable[[str], bool]) -> tuple[str, str, bool]:
    """The payload before and from its first argument, at the top level, for which opens holds."""
    for m in re.finditer(r"[ \t]+", payload):
        head = payload[: m.start()]
        if not head.strip(" \t") or m.end() == len(payload):
            continue
        depth, inside, k = 0, False, 0
        while k < len(head):
            c = head[k]
            if inside:
                k += c == "\\"
                inside = c != '"'
            elif c == '"':
                inside = True
            elif c == "[":
                depth += 1
            elif c == "]":
                depth = max(0, depth - 1)
            k += 1
        if not inside and not depth and opens(payload[m.end() :]):
            return head, payload[m.end() :], True
    return payload, "", False


def parsed(payload: Column) -> Column:
    """A struct of name, args and error; a list argument is JSON text. Null stays null."""

    @F.pandas_udf(SCHEMA)
    def run(payloads: pd.Series) -> pd.DataFrame:
        rows = []
        for p in payloads:
            try:
                name, args = (None, None) if p is None else parse(p)
                rows.append((name, args and [{"key": k, "text": None if isinstance(v, list) else v[0], "quoted": not isinstance(v, list) and v[1], "list": json.dumps(v) if isinstance(v, list) else None, "col": at} for k, v, at in args], None))
            except Refused as e:
                rows.append((None, None, str(e)))
        return pd.DataFrame(rows, columns=["name", "args", "error"])

    return run(payload)


def prefix(name: Column) -> Column:
    """The plugin of a prefixed name; empty for a bare one."""
    return F.when(F.instr(name, ":") > 0, F.substring_index(name, ":", 1)).otherwise("")


def namespace(key: Column) -> Column:
    """What stands before the first dot of a key."""
    return F.substring_index(key, ".", 1)
