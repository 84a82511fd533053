"""URL filters by a temporal list join.

A list is a log of dated entries (pattern, category, verdict, action, since). The entries of one
(pattern, category, verdict) become validity intervals: an ``add`` opens one at its date, the next
entry closes it; a ``remove`` only closes. Every capture is then joined as-of its fetch time with
the intervals of the patterns that its URL falls under, and the most specific active pattern
decides.

Patterns are of four kinds: a host suffix in whole labels (``spam.example.org``), a host alone
(``=www.example.org``), a host with the first path segment (``blog.example.org/ads``), and a whole
address without scheme, port, query and fragment (``=blog.example.org/ads/1``). The list is a table
that grows; nothing of it is in the code. Definitions:

* intervals hold their first instant and not their last; of entries with the same date, ``remove``
  comes first;
* the longest active pattern decides; at equal length ``block`` wins over ``allow``; captures
  under no active pattern are not blocked;
* a null or malformed URL, or a null fetch time, falls under nothing. Entries with a null pattern
  or date are ignored. Equal captures get equal rows of their own.

Scale: a capture makes one narrow row per label of its host and three more. They meet the intervals
in an equi-join on the pattern, where a hot host is split by adaptive execution; nothing is
broadcast by order. Verdicts are put together by a map-side aggregate over the row's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialise, table

FIRST_DAY, DAYS = "2023-01-01", 730
CATEGORIES = ("adult", "ads", "malware", "parked", "spam")


def entries(spark: SparkSession, rows: tuple) -> DataFrame:
    """A list table of (pattern, category, verdict, action, since) rows."""
    return spark.createDataFrame(list(rows), "pattern string, category string, verdict string, action string, since string").withColumn("since", F.to_timestamp("since"))


def drawn_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """A list table for pages that come without one: a quarter of all patterns their addresses fall under, so it
    grows with them. Category, verdict and dates follow from a hash of the pattern; some are removed and added again."""
    h = F.coalesce(host(F.col(url)), F.lit(""))
    patterns = pages.select(h.alias("h"), F.col(url).alias("u")).filter("h <> ''").distinct().select(F.explode(keys(F.col("h"), F.col("u"))).alias("pattern")).distinct()
    x = F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long")
    listed = patterns.select("pattern", x.alias("x")).filter("x % 4 = 0").withColumn("x", F.floor(F.col("x") / 4).cast("long"))
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")).cast("timestamp")
    at = F.col("x") % 365
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(at).alias("since")),
        F.when(F.col("x") % 3 == 0, F.struct(F.lit("remove").alias("action"), day(at + F.col("x") % 200).alias("since"))),
        F.when(F.col("x") % 6 == 0, F.struct(F.lit("add").alias("action"), day(at + 250).alias("since"))),
    )
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("x") % len(CATEGORIES) + 1).cast("int"))
    verdict = F.when(F.floor(F.col("x") / 5) % 3 > 0, "block").otherwise("allow")
    return listed.select("pattern", category.alias("category"), verdict.alias("verdict"), F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("pattern", "category", "verdict", "s.action", "s.since")


def host(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("."))


def keys(h: Column, url: Column) -> Column:
    """All patterns that an address falls under."""
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*(/[^?#]+)", 1))
    first = F.regexp_extract(path, r"^(/[^/]+)", 1)
    own = F.array(F.concat(F.lit("="), h), F.when(first != "", F.concat(h, first)), F.when(path != "", F.concat(F.lit("="), h, path)))
    return F.array_union(suffixes, F.filter(own, lambda k: k.isNotNull()))


def intervals(listed: DataFrame) -> DataFrame:
    """(pattern, category, verdict, start, stop) with an open ``stop`` null."""
    order = Window.partitionBy("pattern", "category", "verdict").orderBy("since", F.col("action") != "remove")
    known = listed.filter("pattern IS NOT NULL AND since IS NOT NULL").withColumn("pattern", F.lower("pattern"))
    out = known.withColumn("stop", F.lead("since").over(order)).filter("action = 'add'")
    return out.select("pattern", "category", "verdict", F.col("since").alias("start"), "stop").filter("stop IS NULL OR stop > start")


def filter_urls(captures: DataFrame, listed: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """The captures with host, decided_by, categories (of all active patterns, sorted) and blocked; these replace any of their names."""
    added = ("host", "decided_by", "categories", "blocked")
    df = captures.select(F.struct(*(c for c in captures.columns if c not in added)).alias("_doc"), F.col(url).alias("_url"), F.col(fetched).alias("_t"), F.coalesce(host(F.col(url)), F.lit("")).alias("host"))
    df = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "captures")
    narrow = df.filter("host <> '' AND _t IS NOT NULL").select("_row", "_t", F.explode(keys(F.col("host"), F.col("_url"))).alias("pattern"))
    active = narrow.join(intervals(listed), "pattern").filter("start <= _t AND (stop IS NULL OR _t < stop)")
    verdicts = active.groupBy("_row").agg(
        F.max(F.struct(F.length("pattern").alias("n"), (F.col("verdict") == "block").alias("block"), "pattern")).alias("_best"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
    )
    out = df.join(verdicts, "_row", "left")
    return out.select("_doc.*", "host", F.col("_best.pattern").alias("decided_by"), F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("_best.block", F.lit(False)).alias("blocked"))


def query(spark, sf_dir: str) -> DataFrame:
    """``pages`` holds no fetch time, so each capture is dated by its page_id (a day within two years), and comes
    without a list, so one is drawn from its addresses."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")).cast("timestamp")
    return filter_urls(pages.select("page_id", "url", day.alias("fetched")), drawn_list(pages)).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


SQL = f"""
WITH parts AS (
  SELECT page_id, url, (DATE '{FIRST_DAY}' + (page_id % {DAYS})::INT)::DATE AS fetched,
         rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         lower(regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*(/[^?#]+)', 1)) AS path
  FROM pages
), captures AS (
  SELECT *, CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), ['=' || host],
    CASE WHEN regexp_extract(path, '^(/[^/]+)', 1) <> '' THEN [host || regexp_extract(path, '^(/[^/]+)', 1)] ELSE [] END,
    CASE WHEN path <> '' THEN ['=' || host || path] ELSE [] END)) END AS keys
  FROM parts
), patterns AS (
  SELECT DISTINCT unnest(keys) AS pattern FROM captures
), hashed AS (
  SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS y FROM patterns
), listed AS (
  SELECT pattern, y // 4 AS x, DATE '{FIRST_DAY}' + ((y // 4) % 365)::INT AS first,
         {list(CATEGORIES)}[1 + ((y // 4) % {len(CATEGORIES)})::INT] AS category, CASE WHEN (y // 4 // 5) % 3 > 0 THEN 'block' ELSE 'allow' END AS verdict
  FROM hashed WHERE y % 4 = 0
), entries AS (
  SELECT pattern, category, verdict, 'add' AS action, first AS since FROM listed
  UNION ALL SELECT pattern, category, verdict, 'remove', first + (x % 200)::INT FROM listed WHERE x % 3 = 0
  UNION ALL SELECT pattern, category, verdict, 'add', first + 250 FROM listed WHERE x % 6 = 0
), steps AS (
  SELECT pattern, category, verdict, action, since::DATE AS start,
         lead(since::DATE) OVER (PARTITION BY pattern, category, verdict ORDER BY since, action <> 'remove') AS stop
  FROM entries
), intervals AS (
  SELECT * FROM steps WHERE action = 'add' AND (stop IS NULL OR stop > start)
), active AS (
  SELECT c.page_id, c.url, i.* FROM (SELECT page_id, url, fetched, unnest(keys) AS pattern FROM captures) c JOIN intervals i
    ON c.pattern = i.pattern AND i.start <= c.fetched AND (i.stop IS NULL OR c.fetched < i.stop)
), verdicts AS (
  SELECT page_id, url, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
         arg_max(pattern, (length(pattern) * 2 + (verdict = 'block')::INT, pattern)) AS decided_by,
         arg_max(verdict = 'block', (length(pattern) * 2 + (verdict = 'block')::INT, pattern)) AS blocked
  FROM active GROUP BY page_id, url
)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d') AS fetched, c.host, v.decided_by, coalesce(v.categories, '') AS categories, coalesce(v.blocked, false) AS blocked
FROM captures c LEFT JOIN verdicts v ON c.page_id = v.page_id AND c.url IS NOT DISTINCT FROM v.url
"""
