"""Comments, wrapping, normalisation, provenance trailers, literals, paths."""

from __future__ import annotations

import posixpath
import re
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS, MARKDOWN = 1, 2
TEXTS = 64  # that are Python strings at a time


def line_comments(text: Column, marker: str, prefix: str = "") -> Column:
    """Every line behind the prefix and the marker, with a final line feed; a carriage return before a line feed goes."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit(prefix + marker), F.regexp_replace(x, "\r$", ""), F.lit("\n")))
    return F.array_join(lines, "")


def block_comment(text: Column, opener: str, gutter: str, closer: str, prefix: str = "") -> Column:
    """The lines behind a gutter, between opener and closer; `*/` inside is escaped."""
    body = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit(prefix + gutter), F.replace(F.regexp_replace(x, "\r$", ""), F.lit("*/"), F.lit("*\\/")), F.lit("\n")))
    return F.concat(F.lit(f"{prefix}{opener}\n"), F.array_join(body, ""), F.lit(f"{prefix}{closer}\n"))


def inline_comment(text: Column) -> Column:
    """` /* text */` on one line; empty for an empty text."""
    flat = F.regexp_replace(text, "\r\n|\n", " ")
    safe = F.replace(F.replace(flat, F.lit("*/"), F.lit("*\\/")), F.lit("/*"), F.lit("/\\*"))
    return F.when(text == "", "").otherwise(F.concat(F.lit(" /* "), safe, F.lit(" */")))


def normalised(text: Column) -> Column:
    """Lines without blanks at their ends, at most one blank line between others, none first or last, a line feed at the end."""
    ends = F.regexp_replace(text, r"[ \t\r]+(?=\n|\z)", "")
    body = F.regexp_replace(F.regexp_replace(ends, r"\A\n+|\n+\z", ""), r"\n{3,}", "\n\n")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def joined(lines: Column) -> Column:
    """Continued lines as one payload: the backslash at a line's end and the blanks around the break become one space."""
    folded = F.transform(lines, lambda x, i: F.when(x.endswith("\\"), F.regexp_replace(x, r"[ \t]*\\$", "")).otherwise(x))
    return F.array_join(F.transform(folded, lambda x, i: F.when(i > 0, F.regexp_replace(x, r"^[ \t]+", "")).otherwise(x)), " ")


def located(lines: list[str], offset: int) -> tuple[int, int]:
    """Line and place in it of a byte of the payload that joined() makes."""
    for i, raw in enumerate(lines):
        part = raw[:-1].rstrip(" \t") if raw.endswith("\\") else raw
        lead = len(part) - len(part.lstrip(" \t")) if i else 0
        size = len(part) - lead
        if offset <= size or i == len(lines) - 1:
            return i, lead + min(offset, size)
        offset -= size + 1
    return 0, 0


def carrier(line: Column, brand: str) -> Column:
    """mark (`+` or `-`) and payload of a comment line `+brand:payload`; null for another line."""
    pattern = rf"^\s*([+-]){re.escape(brand)}:(.*)$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("mark"), F.regexp_extract(line, pattern, 2).alias("payload")))


def stamped(body: Column, prefix: str) -> Column:
    """The body with a trailer line that holds its SHA-256."""
    return F.concat(body, F.lit("\n" + prefix), F.sha2(body, 256))


def verified(text: Column, prefix: str) -> Column:
    """Whether a stamped text still is what was stamped."""
    at = F.length(text) - 64 - len(prefix) - 1
    return (at >= 0) & (F.substr(text, F.greatest(at + 1, F.lit(1)), F.lit(len(prefix) + 1)) == "\n" + prefix) & (F.sha2(F.substr(text, F.lit(1), F.greatest(at, F.lit(0))), 256) == F.right(text, F.lit(64)))


def _opens(word: str, markup: int) -> bool:
    """Whether a line that begins with the word begins a block."""
    if markup & TAGS and word.startswith("@"):
        return True
    return bool(markup & MARKDOWN and re.fullmatch(r"[+*]|[<>].*|```.*|~~~.*|#{1,6}|-+|=+|\*{3,}|_{3,}|[0-9]{1,9}[.)]", word, re.S))


def wrap(text: str, width: int, markup: int = 0) -> list[str]:
    """Lines of at most width characters, greedily, paragraph by paragraph, an empty line between two. A longer word stands alone; a word that would begin a block stays on the line before it; a width below 1 wraps nothing."""
    out: list[str] = []
    for paragraph in re.split(r"\n(?:[ \t\r\v\f]*(?:\n|\Z))+", text):
        words = re.findall(r"[^ \t\n\r\v\f]+", paragraph)
        if not words:
            continue
        if out:
            out.append("")
        line = words[0]
        for word in words[1:]:
            if width < 1 or len(line) + 1 + len(word) <= width or _opens(word, markup):
                line += " " + word
            else:
                out.append(line)
                line = word
        out.append(line)
    return out


def wrap_batch(texts: pa.Array, width: int, markup: int = 0) -> pa.Array:
    """The lines of each text, null for a null. A batch is held as Arrow arrays; only a few texts at a time are Python strings."""
    parts = [pa.array([], pa.list_(pa.string()))]
    for at in range(0, len(texts), TEXTS):
        lines = [None if t is None else wrap(t, width, markup) for t in texts.slice(at, TEXTS).to_pylist()]
        parts.append(pa.array(lines, pa.list_(pa.string())))
    return pa.concat_arrays(parts)


def wrapped(text: Column, width: int, markup: int = 0) -> Column:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return wrap_batch(texts, width, markup)

    return run(text)


def integer_literal(text: Column, cls: str, bits: int) -> Column:
    """The number a literal spells, if it fits an int or uint of that width; else null."""
    low, high = (0, 2**bits - 1) if cls == "uint" else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,37}$"), text.cast("decimal(38,0)"))
    return F.when(number.between(F.lit(Decimal(low)), F.lit(Decimal(high))), number)


def boolean_literal(text: Column) -> Column:
    """true and false, in this spelling alone."""
    return F.when(text == "true", True).when(text == "false", False)


def decimal_spelling(value: float, bits: int = 64) -> str:
    """The shortest decimal text that reads back: positional from 1e-6 up to 1e21, else with an exponent that is not padded."""
    x = np.float32(value) if bits == 32 else np.float64(value)
    size = abs(x)
    kind = type(x)
    if size != 0 and (size < kind(1e-6) or size >= kind(1e21)):
        text = np.format_float_scientific(x, unique=True, trim="-", exp_digits=1)
        return re.sub(r"e([+-])(\d)$", lambda m: f"e{m[1]}{m[2]}" if m[1] == "-" else f"e+0{m[2]}", text)
    return np.format_float_positional(x, unique=True, trim="-")


@F.pandas_udf(T.StringType())
def decimal_text(values: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else decimal_spelling(v) for v in values], dtype="object")


def redirect(base: str, override: str) -> tuple[str, str] | None:
    """Directory and file of a path override below base; an override that ends in a slash names a directory. None if it is absolute, has a backslash or leaves the tree."""
    if override.startswith("/") or "\\" in override:
        return None
    whole = posixpath.normpath(posixpath.join(base, override))
    if whole == ".." or whole.startswith("../"):
        return None
    last = posixpath.basename(override.rstrip("/")) or "."
    if override.endswith("/") or last in (".", ".."):
        return whole, ""
    return posixpath.dirname(whole) or ".", posixpath.basename(whole)


def glob_pattern(pattern: str) -> str:
    """A Java regular expression for a slash glob: `**` spans segments, `*`, `?` and classes stay within one."""
    out, segments = "", pattern.split("/")
    for k, segment in enumerate(segments):
        if segment == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if k == len(segments) - 1 else "(?:[^/]+/)*"
            continue
        i = 0
        while i < len(segment):
            c = segment[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and "]" in segment[i + 1 :]:
                end = segment.index("]", i + 1)
                out += "[" + segment[i + 1 : end].replace("\\", "\\\\") + "]"
                i = end
            elif c == "\\" and i + 1 < len(segment):
                i += 1
                out += re.escape(segment[i])
            else:
                out += re.escape(c)
            i += 1
        if k < len(segments) - 1:
            out += "/"
    return rf"\A{out}\z"


def claimed(path: Column, patterns: list[str]) -> Column:
    """Whether the patterns cover a path: the last that matches decides, and one that begins with `!` carves out."""
    out = F.lit(False)
    for p in patterns:
        out = F.when(path.rlike(glob_pattern(p.removeprefix("!"))), not p.startswith("!")).otherwise(out)
    return out
