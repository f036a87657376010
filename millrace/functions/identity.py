"""Identities of declarations: spelling, parsing, order. Columns lang, package, owner, name, kind, disc.

Parts are never null; an absent part is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALLABLE = ("Function", "Method")

# The kinds of declarations, in the order of their ordinals (from 1; 0 is none).
KINDS = ("Function", "Method", "Param", "Return", "Package", "File", "Import", "Export", "Binding", "Enum", "EnumVariant", "Sum", "SumVariant", "Field", "Variable", "Constant", "Struct", "Interface", "Alias", "TypeRef", "TypeParam", "Embed", "TagEntry")


def kind_ordinal(kind: Column) -> Column:
    """The ordinal of a kind's name; null for a name that is none."""
    at = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    return F.when(at > 0, at)


def spelled(lang: Column, package: Column, owner: Column, name: Column, kind: Column, disc: Column) -> Column:
    """`lang:package`, `lang:package/file`, `lang:package.Name` or `lang:package.Owner#Name`; callables end in their discriminator in parentheses."""
    head = F.concat(lang, F.lit(":"), package)
    member = F.concat(head, F.lit("."), F.when(owner != "", F.concat(owner, F.lit("#"))).otherwise(""), name, F.when(kind.isin(*CALLABLE), F.concat(F.lit("("), disc, F.lit(")"))).otherwise(""))
    return F.when(kind == "File", F.concat(head, F.lit("/"), name)).when(name == "", head).otherwise(member)


def parsed(text: Column) -> Column:
    """A struct of the six parts; null for a text that spells no identity. The kind is known only of packages and callables.

    A path is cut at the first dot after its last slash, so a file, and a package with a dot in its
    last segment, do not come back as they were.
    """
    lang = F.substring_index(text, ":", 1)
    rest = F.substr(text, F.length(lang) + 2)
    opened = F.instr(rest, "(") > 0
    disc = F.when(opened, F.regexp_extract(rest, r"(?s)^[^(]*\((.*)\)$", 1)).otherwise("")
    body = F.regexp_extract(rest, r"(?s)^([^(]*)", 1)
    is_member = F.instr(body, "#") > 0
    left = F.substring_index(body, "#", 1)
    member = F.substr(body, F.length(left) + 2)
    package, dotted, tail = split_name(F.when(is_member, left).otherwise(body))
    owner = F.when(is_member, tail).otherwise("")
    name = F.when(is_member, member).otherwise(tail)
    kind = F.when(is_member & opened, "Method").when(is_member, "").when(~dotted, "Package").when(opened, "Function").otherwise("")
    good = (F.instr(text, ":") > 1) & (rest != "") & (~opened | rest.endswith(")"))
    good = good & F.when(is_member, dotted & (tail != "") & (member != "")).otherwise(F.when(dotted, tail != "").otherwise(~opened))
    return F.when(good, F.struct(lang.alias("lang"), package.alias("package"), owner.alias("owner"), name.alias("name"), kind.alias("kind"), disc.alias("disc")))


def split_name(path: Column) -> tuple[Column, Column, Column]:
    """Package, whether there is a name, and the name: cut at the first dot after the last slash."""
    last = F.substring_index(path, "/", -1)
    dotted = F.instr(last, ".") > 0
    package = F.when(dotted, F.regexp_extract(path, r"(?s)^((?:.*/)?[^/.]*)\.", 1)).otherwise(path)
    return package, dotted, F.when(dotted, F.substr(path, F.length(package) + 2)).otherwise("")


def flat_name(owner: Column, name: Column) -> Column:
    """The owners (joined by dots) and the name as one word: each part after the first begins with a capital."""
    parts = F.split(F.when(owner == "", name).otherwise(F.concat(owner, F.lit("."), name)), r"\.")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))), "")


def package_identity(lang: Column, package: Column) -> Column:
    return F.struct(lang.alias("lang"), package.alias("package"), F.lit("").alias("owner"), F.lit("").alias("name"), F.lit("Package").alias("kind"), F.lit("").alias("disc"))


def ordering(prefix: str = "") -> list[Column]:
    """The canonical order: byte-wise by part, kinds by ordinal."""
    c = lambda n: F.col(prefix + n)
    return [c("lang"), c("package"), c("owner"), c("name"), kind_ordinal(c("kind")), c("disc")]


def edge_hash(text: Column) -> Column:
    """The first eight bytes of the SHA-256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket_of(path: Column) -> Column:
    """Two hexadecimal digits of the SHA-256: one of 256 shards."""
    return F.substring(F.sha2(path, 256), 1, 2)


def code_parts(code: Column) -> Column:
    """Prefix and number of a diagnostic code such as `EID-0062`; null for a text that is none."""
    prefix, digits = F.regexp_extract(code, r"^([A-Z]+)-", 1), F.regexp_extract(code, r"-(\d{4}|[1-9]\d{4,8})$", 1)
    good = code.rlike(r"^[A-Z]+-(\d{4}|[1-9]\d{4,8})$") & (digits.cast("int") > 0)
    return F.when(good, F.struct(prefix.alias("prefix"), digits.cast("int").alias("number")))


def position_parts(text: Column) -> Column:
    """file, line and column of `file:line:col`; null for a text that is none."""
    pattern = r"^(.+):(\d{1,9}):(\d{1,9})$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col")))
