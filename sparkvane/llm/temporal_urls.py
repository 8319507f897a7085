"""URL filters by a temporal list join.

A filter list is a history of dated entries (pattern, action, listed_on, and optionally delisted_on): an entry holds until the next one of the same
pattern, or until it is delisted. Entries become validity intervals [active_from, active_until), and every capture (url, fetched_at) is joined as of its fetch
time: only entries active then count. A pattern is a host (it covers its subdomains) or a host with the first directory
of a path, as ``host/dir``. Of the active entries that cover a capture the most specific one, the longest pattern,
decides: ``block`` rejects it, ``allow`` keeps it.

The join is an equality on the pattern with the time range as a condition. Each URL has only a handful of patterns, so the exploded
side grows with the URLs' host depth, and the list may be of any size: Spark broadcasts it only below its own threshold.

URLs and patterns are brought to one form: the host without case, user name, port and final dot; the directory with its case. A pattern may also have a
scheme and a final slash.

Nulls and edge cases: a capture with a null or unparsable URL, or a null fetch time, matches nothing and is kept. Entries
with a null pattern, action or listing date, an action other than ``block`` and ``allow`` (in any case), a pattern of another form, or a delisting not after the listing
are ignored; of several entries for one pattern and time ``block`` wins, then the latest delisting, none being the latest. An entry is active from its own
instant on. Equally long patterns for one capture are decided by their order as text. Rows equal in key, URL and time are judged alike and all returned. Very long URLs are matched whole. An empty list blocks nothing; no captures give no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#].*)?$"
DIRECTORY = r"^[^:/?#]+://[^/?#]*/([^/?#]+)/"
PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:/([^/?#]+))?/?$"


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.nullif(F.regexp_extract(url, HOST, 1), F.lit("")))


def patterns_of(url: F.Column) -> F.Column:
    """All patterns that cover a URL: the host and its parents down to two labels, and the host with its first directory."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    directory = F.regexp_extract(url, DIRECTORY, 1)
    return F.when(directory != "", F.array_append(suffixes, F.concat(host, F.lit("/"), directory))).otherwise(suffixes)


def normal_pattern(pattern: F.Column) -> F.Column:
    """An entry's pattern in the form that ``patterns_of`` gives; null if it has another one."""
    host, directory = (F.nullif(F.regexp_extract(pattern, PATTERN, k), F.lit("")) for k in (1, 2))
    return F.when(directory.isNull(), F.lower(host)).otherwise(F.concat(F.lower(host), F.lit("/"), directory))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, active_from, active_until) of a list's history; an open end is null."""
    end = F.col("delisted_on").cast("timestamp") if "delisted_on" in entries.columns else F.lit(None).cast("timestamp")
    e = entries.select(normal_pattern(F.col("pattern")).alias("pattern"), F.lower("action").alias("action"), F.col("listed_on").cast("timestamp").alias("active_from"), end.alias("end"))
    e = e.dropna(subset=["pattern", "action", "active_from"]).where(F.col("action").isin("block", "allow") & (F.col("end").isNull() | (F.col("end") > F.col("active_from"))))
    best = F.max(F.struct(F.col("action"), F.col("end").isNull().alias("open"), F.col("end"))).alias("b")  # "block" > "allow"
    one = e.groupBy("pattern", "active_from").agg(best).select("pattern", "active_from", "b.action", "b.end")
    following = F.lead("active_from").over(Window.partitionBy("pattern").orderBy("active_from"))
    return one.select("pattern", "action", "active_from", F.least(following, F.col("end")).alias("active_until"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, fetched_at, pattern, action, blocked) of every capture."""
    same = [key, "url", "fetched_at"]
    distinct = captures.groupBy(*same).agg(F.count("*").alias("copies"))
    asked = distinct.withColumn("pattern", F.explode_outer(F.when(F.col("fetched_at").isNotNull(), patterns_of(F.col("url")))))
    active = intervals(entries)
    hit = asked.join(active, (asked["pattern"] == active["pattern"]) & (F.col("fetched_at") >= F.col("active_from")) & (F.col("active_until").isNull() | (F.col("fetched_at") < F.col("active_until"))), "left")
    hit = hit.select(*same, "copies", active["pattern"].alias("p"), "action")
    # Longest pattern first; two of one length can't cover one URL unless they are equal, but for host/dir against a subdomain: by text.
    best = hit.groupBy(*same, "copies").agg(F.max(F.when(F.col("p").isNotNull(), F.struct(F.length("p").alias("n"), F.col("p").alias("pattern"), F.col("action").alias("action")))).alias("b"))
    rows = best.select(*same, "b", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(*same, F.col("b.pattern").alias("pattern"), F.col("b.action").alias("action"), F.coalesce(F.col("b.action") == "block", F.lit(False)).alias("blocked"))


# The tables have neither fetch times nor a list. Both are derived from the pages themselves, by arithmetic that SQL can repeat.


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages fetched over a year: a minute that follows from the id. Some directories get capitals, which make them other directories."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(527040))
    url = F.when(F.col("page_id") % 11 == 0, F.regexp_replace("url", "/en/", "/EN/")).otherwise(F.col("url"))
    return pages.select("page_id", url.alias("url"), F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A list history over the pages' hosts: two thirds of them are blocked at some time, three sevenths of these delisted later; parent domains and directories have entries too, in several notations."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    h = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long"))
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    end = lambda n: F.when(F.col("h") % 7 < 3, day(n + 30 + F.col("h") % 90))
    none = F.lit(None).cast("timestamp").alias("delisted_on")
    block = h.where("h % 3 < 2").select(F.col("host").alias("pattern"), F.lit("block").alias("action"), day(F.col("h") % 200).alias("listed_on"), end(F.col("h") % 200).alias("delisted_on"))
    allow = h.where("h % 3 = 0").select(F.concat(F.upper("host"), F.lit(".")).alias("pattern"), F.lit("ALLOW").alias("action"), day(200 + F.col("h") % 100).alias("listed_on"), none)
    parent = h.select(F.concat(F.substring_index("host", ".", -2), F.lit(":443")).alias("pattern"), F.lit("block").alias("action"), day(F.lit(300)).alias("listed_on"), none).where("pattern like '%.org:443'").distinct()
    folder = h.where("h % 5 = 0").select(F.concat(F.lit("https://"), F.initcap("host"), F.when(F.col("h") % 2 == 0, "/en").otherwise("/EN/")).alias("pattern"), F.lit("allow").alias("action"), day(F.col("h") % 50).alias("listed_on"), end(F.col("h") % 50).alias("delisted_on"))
    return block.unionByName(allow).unionByName(parent).unionByName(folder)


def _sql_pattern(p: str) -> str:
    host, directory = (f"nullif(regexp_extract({p}, '{PATTERN}', {k}), '')" for k in (1, 2))
    return f"CASE WHEN {directory} IS NULL THEN lower({host}) ELSE lower({host}) || '/' || {directory} END"


SQL = f"""
WITH cap AS (
  SELECT *, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, regexp_extract(url, '{DIRECTORY}', 1) AS dir
  FROM (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN replace(url, '/en/', '/EN/') ELSE url END AS url, make_timestamp((1704067200 + ((page_id * 7919) % 527040) * 60) * 1000000) AS fetched_at FROM pages)),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 7))::BIGINT AS h FROM (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL)),
entries AS (
  SELECT host AS pattern, 'block' AS action, h % 200 AS d, CASE WHEN h % 7 < 3 THEN h % 200 + 30 + h % 90 END AS e FROM h WHERE h % 3 < 2
  UNION ALL SELECT upper(host) || '.', 'ALLOW', 200 + h % 100, NULL FROM h WHERE h % 3 = 0
  UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') || ':443', 'block', 300, NULL FROM h WHERE host LIKE '%.org'
  UNION ALL SELECT 'https://' || upper(host[1]) || host[2:] || CASE WHEN h % 2 = 0 THEN '/en' ELSE '/EN/' END, 'allow', h % 50, CASE WHEN h % 7 < 3 THEN h % 50 + 30 + h % 90 END FROM h WHERE h % 5 = 0),
one AS (SELECT pattern, d, max(struct_pack(action := action, open := e IS NULL, e := e)) AS b FROM (SELECT {_sql_pattern('pattern')} AS pattern, lower(action) AS action, d, e FROM entries) GROUP BY pattern, d),
spans AS (SELECT pattern, b.action AS action, make_timestamp((1704067200 + d * 86400) * 1000000) AS a,
  make_timestamp((1704067200 + least(b.e, lead(d) OVER (PARTITION BY pattern ORDER BY d)) * 86400) * 1000000) AS z FROM one),
asked AS (
  SELECT page_id, url, fetched_at, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
         || CASE WHEN dir <> '' THEN [host || '/' || dir] ELSE [] END) AS pattern
  FROM cap),
hit AS (SELECT q.page_id, q.url, s.pattern, s.action FROM asked q JOIN spans s ON q.pattern = s.pattern AND q.fetched_at >= s.a AND (s.z IS NULL OR q.fetched_at < s.z)),
best AS (SELECT page_id, url, max(struct_pack(n := length(pattern), pattern := pattern, action := action)) AS b FROM hit GROUP BY page_id, url)
SELECT c.page_id, c.url, c.fetched_at, b.b.pattern AS pattern, b.b.action AS action, coalesce(b.b.action = 'block', false) AS blocked
FROM cap c LEFT JOIN best b ON b.page_id = c.page_id AND b.url = c.url
"""
