"""URL filtering by a temporal list join.

A list has dated entries: from a day on, a pattern is blocked, allowed, or dropped from the list. The
entries of a pattern become validity intervals, and every capture is judged by the entries that were
valid on the day it was fetched; of several patterns the longest decides. A pattern is a host, any of
its parent domains (an address has none), or a host with the first segment of the path. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)"
ADDRESS = r"^\[|^[0-9]+(\.[0-9]+){3}$"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"
OPEN_END = 1 << 30


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without a final dot; an IPv6 address stands in brackets. Null without one."""
    host = F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))
    return F.when(host != "", host)


def first_segment(url: Column) -> Column:
    """The first segment of the path in lower case; empty without one."""
    return F.regexp_extract(F.lower(url), SEGMENT, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, category, since, until (days; until is open) of every entry in force for a while.

    entries: entry_id, day (days since 1970-01-01), pattern, action (block, allow or drop), category.
    An entry ends the one before it of its pattern; of entries of one day the last entry_id counts,
    of equal ones the greatest action and category. Entries with a null pattern, day or action count
    as absent.
    """
    known = entries.where("pattern is not null and day is not null and action is not null").select("entry_id", F.col("day").cast("int").alias("since"), F.lower("pattern").alias("pattern"), "action", "category").distinct()
    after = Window.partitionBy("pattern").orderBy("since", "entry_id", "action", "category")
    ended = known.withColumn("until", F.coalesce(F.lead("since").over(after), F.lit(OPEN_END)))
    return ended.where("until > since and action <> 'drop'").select("pattern", "action", "category", "since", "until")


def candidates(host: Column, segment: Column) -> Column:
    """Patterns that can name a capture: the host, its parents of two labels or more, the host with the segment. IP addresses have no parents."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.when((n > 1) & ~host.rlike(ADDRESS), F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))).otherwise(F.array(host))
    return F.array_distinct(F.when(segment != "", F.concat(parents, F.array(F.concat(host, F.lit("/"), segment)))).otherwise(parents))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of captures (id, url, day): id, host, day, blocked, rule, category, since.

    rule is the longest pattern in force on that day, with its category and first day; null if there
    is none, as for a null URL, one without a host, or a null day. Equal places on one day are judged
    once, before anything is joined, so a host that makes up a third of the captures costs one row a
    day and segment. Empty tables give no rows, or no rule.
    """
    placed = captures.select("id", "day", host_of(F.col("url")).alias("host"), first_segment(F.col("url")).alias("segment"))
    places = placed.where("host is not null and day is not null").select("host", "segment", "day").distinct()
    tried = places.withColumn("pattern", F.explode(candidates(F.col("host"), F.col("segment"))))
    hit = tried.join(intervals(entries), "pattern").where("day >= since and day < until")
    best = F.max(F.struct(F.length("pattern").alias("length"), "pattern", "action", "category", "since")).alias("best")
    verdicts = hit.groupBy("host", "segment", "day").agg(best)
    # Captures without a host or day are not joined: as nulls they would all meet in one task.
    known = F.col("host").isNotNull() & F.col("day").isNotNull()
    out = placed.where(known).join(verdicts, ["host", "segment", "day"], "left").select("id", "host", "day", "best.action", "best.pattern", "best.category", "best.since")
    out = out.unionByName(placed.where(~known).select("id", "host", "day"), allowMissingColumns=True)
    return out.select("id", "host", "day", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"), F.col("pattern").alias("rule"), "category", "since")


def _draw(key: Column, at: int) -> Column:
    """A number fixed by the key: four hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(key), at, 4), 16, 10).cast("int")


def sample_list(urls: DataFrame) -> DataFrame:
    """A dated list over the hosts and first segments of urls (url), fixed by their MD5s.

    Half of the hosts, a quarter of their domains of two labels, and a sixth of the places with a
    segment have a first entry on a day of 2024; most of them a second one later, and some a third.
    """
    host, segment = host_of(F.col("url")), first_segment(F.col("url"))
    places = urls.select(host.alias("host"), segment.alias("segment")).where("host is not null").distinct()
    domain = F.when(F.col("host").rlike(ADDRESS), F.col("host")).otherwise(F.substring_index("host", ".", -2))
    named = places.select(F.col("host").alias("pattern"), F.lit(2).alias("part")).union(places.select(domain, F.lit(4))).union(places.where("segment <> ''").select(F.concat("host", F.lit("/"), "segment"), F.lit(6)))
    key = F.col("pattern")
    chosen = named.groupBy("pattern").agg(F.min("part").alias("part")).where(_draw(key, 1) % F.col("part") == 0)
    first = 19723 + _draw(key, 5) % 200
    second = first + 1 + _draw(key, 9) % 120
    third = second + 1 + _draw(key, 13) % 120
    category = F.element_at(F.array(*[F.lit(c) for c in ("adult", "gambling", "malware", "spam")]), _draw(key, 17) % 4 + 1)
    rows = F.array(
        F.struct(F.lit(1).alias("entry_id"), first.alias("day"), F.when(_draw(key, 21) % 3 == 0, "allow").otherwise("block").alias("action")),
        F.struct(F.lit(2).alias("entry_id"), second.alias("day"), F.when(_draw(key, 25) % 4 == 0, "block").otherwise("drop").alias("action")),
        F.struct(F.lit(3).alias("entry_id"), third.alias("day"), F.when(_draw(key, 29) % 2 == 0, "block").otherwise("drop").alias("action")),
    )
    return chosen.select("pattern", category.alias("category"), F.explode(rows).alias("e")).select("e.entry_id", "e.day", "pattern", "e.action", "category")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page, as fetched on a day of 2024 that its id fixes, against a list drawn from the hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("id"), "url", (19723 + F.pmod(F.col("page_id"), F.lit(366))).cast("int").alias("day"))
    return judge(captures, sample_list(pages)).select(F.col("id").alias("page_id"), "host", "day", "blocked", "rule", "category", "since")


_SQL = r"""
with captures as (
  select page_id, cast(19723 + page_id % 366 as int) as day,
    nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)', 1), '.'), '') as host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) as segment
  from pages),
places as (select distinct host, segment from captures where host is not null),
named as (
  select host as pattern, 2 as part from places
  union all select case when regexp_matches(host, '^\[|^[0-9]+(\.[0-9]+){3}$') then host else array_to_string(string_split(host, '.')[-2:], '.') end, 4 from places
  union all select host || '/' || segment, 6 from places where segment <> ''),
drawn as (
  select pattern, part, md5(pattern) as h from (select pattern, min(part) as part from named group by pattern) x),
draws as (
  select pattern, part, [cast('0x' || substr(h, 4 * i + 1, 4) as int) for i in [0, 1, 2, 3, 4, 5, 6, 7]] as d from drawn),
chosen as (
  select pattern, d, ['adult', 'gambling', 'malware', 'spam'][d[5] % 4 + 1] as category,
    19723 + d[2] % 200 as first, 19723 + d[2] % 200 + 1 + d[3] % 120 as second, 19723 + d[2] % 200 + 1 + d[3] % 120 + 1 + d[4] % 120 as third
  from draws where d[1] % part = 0),
entries as (
  select pattern, category, first as since, case when d[6] % 3 = 0 then 'allow' else 'block' end as action from chosen
  union all select pattern, category, second, case when d[7] % 4 = 0 then 'block' else 'drop' end from chosen
  union all select pattern, category, third, case when d[8] % 2 = 0 then 'block' else 'drop' end from chosen),
valid as (
  select * from (select *, coalesce(lead(since) over (partition by pattern order by since), 1073741824) as until from entries) x where action <> 'drop'),
tried as (
  select page_id, day, unnest(list_distinct(list_concat(
    case when len(string_split(host, '.')) > 1 and not regexp_matches(host, '^\[|^[0-9]+(\.[0-9]+){3}$') then [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')))] else [host] end,
    case when segment <> '' then [host || '/' || segment] else [] end))) as pattern
  from captures where host is not null),
best as (
  select page_id, pattern, action, category, since, row_number() over (partition by page_id order by length(pattern) desc, pattern desc) as k
  from tried join valid using (pattern) where day >= since and day < until)
select c.page_id, c.host, c.day, coalesce(b.action = 'block', false) as blocked, b.pattern as rule, b.category, cast(b.since as int) as since
from captures c left join best b on b.page_id = c.page_id and b.k = 1"""

SQL = {"op9_url_filter": _SQL}
