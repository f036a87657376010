"""Splitting names into words, and casing them.

The splitting rules look ahead by two characters and know plurals of acronyms, which no built-in
expression does; they run as Arrow UDFs. Names repeat a lot, so callers apply them to distinct names.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = frozenset("_-. \t/")

# The initialisms that are known without being listed by a caller.
INITIALISMS = frozenset("ACL API ASCII CPU CSS DNS EOF GUID HTML HTTP HTTPS ID IP JSON LHS QPS RAM RHS RPC SLA SMTP SQL SSH TCP TLS TTL UDP UI UID UUID URI URL UTF8 VM XML XMPP XSRF XSS".split())


def words(name: str) -> list[str]:
    """Words of a name: cut at separators, before a capital after a lower-case letter or digit, and before the last capital of a run that a lower-case letter follows, unless that is the plural s of the run."""
    out, word = [], ""
    for i, c in enumerate(name):
        if c in SEPARATORS:
            if word:
                out.append(word)
            word = ""
            continue
        if i and word and c.isupper():
            p, after = name[i - 1], name[i + 1 : i + 2]
            plural = after == "s" and not name[i + 2 : i + 3].islower()
            if p.islower() or p.isdecimal() or (p.isupper() and after.islower() and not plural):
                out.append(word)
                word = ""
        word += c
    return [*out, word] if word else out


class Caser:
    """Case conversion with a set of initialisms."""

    def __init__(self, more: Iterable[str] = (), known: Iterable[str] = INITIALISMS) -> None:
        self.known = frozenset(known) | {w.upper() for w in more}

    def _titled(self, word: str, keep_upper: bool) -> str:
        if word.upper() in self.known:
            return word.upper()
        if word[-1:] in "sS" and word[:-1].upper() in self.known and (word[-1] == "s" or not word.isupper()):
            return word[:-1].upper() + "s"
        stem = word[:-1] if word.endswith("s") else word
        if keep_upper and stem.isascii() and len(stem) > 1 and stem.isupper():
            return word
        return word[:1].upper() + word[1:].lower()

    def pascal(self, name: str) -> str:
        """Every word with a capital; initialisms and runs of capitals stay. An upper-case identifier is returned as it is."""
        if name[:1].isalpha() and name.isascii() and name == name.upper() and name.replace("_", "").isalnum():
            return name
        return "".join(self._titled(w, True) for w in words(name))

    def camel(self, name: str) -> str:
        """As pascal, but the first word is lower case, and a name without lower-case letters has no runs of capitals to keep."""
        keep = any(c.islower() for c in name)
        return "".join(w.lower() if k == 0 else self._titled(w, keep) for k, w in enumerate(words(name)))


def snake(name: str) -> str:
    return "_".join(w.lower() for w in words(name))


def screaming_snake(name: str) -> str:
    return "_".join(w.upper() for w in words(name))


def kebab(name: str) -> str:
    return "-".join(w.lower() for w in words(name))


def _udf(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(names: pd.Series) -> pd.Series:
        return names.map(f, na_action="ignore")

    return run


_DEFAULT = Caser()


def words_col(name: Column) -> Column:
    return _udf(words, "array<string>")(name)


def cased(name: Column, style: str, caser: Caser = _DEFAULT) -> Column:
    """The name in a style: pascal, camel, snake, screaming_snake, kebab. Null stays null."""
    styles = {"pascal": caser.pascal, "camel": caser.camel, "snake": snake, "screaming_snake": screaming_snake, "kebab": kebab}
    return _udf(styles[style])(name)


def is_identifier(name: Column) -> Column:
    """ASCII letters, digits and underscores, with no digit first."""
    return name.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")


def filename_parts(key: Column, word: Column, tag: Column) -> Column:
    """The stem of the key's last segment, the word and the tag, without those that are empty."""
    last = F.substring_index(F.rtrim(key, F.lit("/")), "/", -1)
    stem = F.regexp_replace(last, r"\.[^.]*$", "")
    parts = F.array(F.when((key != "") & (last != "."), stem), word, tag)
    return F.filter(parts, lambda p: p.isNotNull() & (p != ""))


def snake_filename(key: Column, word: Column, tag: Column, ext: Column) -> Column:
    return F.concat(cased(F.array_join(filename_parts(key, word, tag), "_"), "snake"), ext)


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance over the UTF-8 bytes: insertions, deletions, substitutions, swaps of neighbours; no byte is edited twice."""
    x, y = a.encode(), b.encode()
    before: list[int] = []
    last = list(range(len(y) + 1))
    for i in range(1, len(x) + 1):
        row = [i]
        for j in range(1, len(y) + 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


@F.pandas_udf(T.LongType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def distance(a: Column, b: Column) -> Column:
    return _osa(a, b)


def near(a: Column, b: Column) -> Column:
    """At most two edits, and at most a third of the longer name's bytes; null for a null name. A swap is two plain edits, so names more than four plain edits apart are settled without Python."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    gap = F.abs(F.octet_length(a) - F.octet_length(b))
    close = (gap <= 2) & (gap * 3 <= longer) & (F.levenshtein(a, b, 4) >= 0)
    d = distance(F.when(close, a), F.when(close, b))
    return F.when(a.isNotNull() & b.isNotNull(), close & F.coalesce((d <= 2) & (d * 3 <= longer), F.lit(False)))
