"""URL filters by a temporal join with dated lists.

A list is a log: on a day, a pattern was added to it or removed from it. A pattern is a domain (``example.com``: the host itself
and every host below it) or a host with the first segment of its path (``example.com/en/``). The log becomes validity intervals
[from, until), one per stretch in which a pattern was on a list. A capture is judged by the entries that were active when it was
fetched, not by the list of today.

The join is an equality on (pattern, period): intervals stand in every period of ``period`` days that they touch, so a pattern
with a long history only meets the captures of the same days. Captures are folded to different (host, segment, day) first,
because nothing else matters to the verdict: a host of a third of all captures is a few rows per day. All of it is DataFrame
functions; the html column is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PERIOD = 32
SALTS = 16  # parts of the captures under one domain, so that a suffix of most hosts is not one task
# A host is a name, or an address in brackets.
ADDRESS = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]+)(?::[0-9]*)?(/[^/?#]*/)?"


def place(url: Column) -> dict[str, Column]:
    """Lower-case host (null if there is none) and first path segment with its slashes (empty if there is none)."""
    lowered = F.lower(F.trim(url))
    host = F.nullif(F.rtrim(F.regexp_extract(lowered, ADDRESS, 1), F.lit(".")), F.lit(""))
    return {"host": host, "segment": F.coalesce(F.regexp_extract(lowered, ADDRESS, 2), F.lit(""))}


def intervals(log: DataFrame) -> DataFrame:
    """(list, pattern, from, until) from (list, pattern, action, day); ``until`` is null while an entry is still active.

    Rows with a null are ignored. Of an add and a removal on one day the removal counts; adding twice changes nothing.
    """
    last = log.filter("list IS NOT NULL AND pattern IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL").groupBy("list", F.lower("pattern").alias("pattern"), "day").agg(
        F.max((F.col("action") == "remove").cast("int")).alias("off"))
    history = W.partitionBy("list", "pattern").orderBy("day")
    changes = last.withColumn("was", F.lag("off", 1, 1).over(history)).filter("off != was")
    return changes.withColumn("until", F.lead("day").over(history)).filter("off = 0").select("list", "pattern", F.col("day").alias("from"), "until")


def judge(captures: DataFrame, log: DataFrame, url: str = "url", day: str = "fetched", period: int = PERIOD) -> DataFrame:
    """``captures`` with host, ``lists`` (names of lists with an active entry, sorted), ``n_entries`` and ``blocked``.

    A capture without host or day meets no entry. Rows are neither merged nor dropped; columns of these names are replaced.
    """
    where = place(F.col(url))
    placed = captures.withColumns({"host": where["host"], "_segment": where["segment"], "_day": F.col(day)})
    known = placed.filter("host IS NOT NULL AND _day IS NOT NULL").select("host", "_segment", "_day").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.when(F.col("_segment") == "", domains).otherwise(F.concat(domains, F.array(F.concat("host", "_segment"))))
    asked = known.select("*", F.explode(F.array_distinct(keys)).alias("pattern"), F.floor(F.col("_day") / period).alias("period"))
    # Every host asks for its top domain, which hardly a list names: what no list names goes first, in salted parts.
    salted = asked.withColumn("_salt", F.pmod(F.xxhash64("host", "_day"), F.lit(SALTS)))
    listed = log.select(F.lower("pattern").alias("pattern")).filter("pattern IS NOT NULL").distinct()
    listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    keyed = salted.join(listed, ["pattern", "_salt"], "left_semi").drop("_salt")
    horizon = known.agg(F.max("_day").alias("end"))  # one row
    active = intervals(log).join(F.broadcast(horizon), F.col("from") <= F.col("end"))
    upto = F.least(F.coalesce(F.col("until") - 1, F.col("end")), F.col("end"))
    periods = F.sequence(F.floor(F.col("from") / period), F.floor(upto / period))
    spread = active.select("list", "pattern", "from", "until", F.explode(periods).alias("period"))
    met = keyed.join(spread, ["pattern", "period"]).filter("_day >= from AND (until IS NULL OR _day < until)")
    verdict = met.groupBy("host", "_segment", "_day").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.count("*").alias("n_entries"))
    joined = placed.drop("lists", "n_entries", "blocked").join(verdict, ["host", "_segment", "_day"], "left")
    named = joined.withColumns({"lists": F.coalesce("lists", F.lit("")), "n_entries": F.coalesce("n_entries", F.lit(0)), "blocked": F.col("n_entries").isNotNull()})
    return named.drop("_segment", "_day")


# The given pages have no fetch day and come with no list, so both are derived from them, alike in Spark and in the check.
CAPTURES = "SELECT page_id, url, CAST((page_id * 7919) % 730 AS INT) AS fetched FROM {pages}"
LOG = r"""
WITH hosts AS (SELECT regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, min(page_id) AS m FROM {pages} WHERE url IS NOT NULL GROUP BY 1),
sites AS (SELECT regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) AS site, min(m) AS m FROM hosts GROUP BY 1)
SELECT 'spam' AS list, host AS pattern, 'add' AS action, CAST((m * 31) % 600 AS INT) AS day FROM hosts WHERE m % 3 <> 1
UNION ALL SELECT 'spam', host, 'remove', CAST((m * 31) % 600 + 40 + (m * 17) % 100 AS INT) FROM hosts WHERE m % 3 = 0
UNION ALL SELECT 'spam', host, 'add', CAST((m * 31) % 600 + 150 AS INT) FROM hosts WHERE m % 6 = 0
UNION ALL SELECT 'spam', host, 'add', CAST((m * 31) % 600 + 5 AS INT) FROM hosts WHERE m % 4 = 0
UNION ALL SELECT 'mirror', site, 'add', CAST((m * 13) % 500 AS INT) FROM sites WHERE m % 4 = 1 AND site <> ''
UNION ALL SELECT 'mirror', site, 'remove', CAST((m * 13) % 500 + 90 AS INT) FROM sites WHERE m % 8 = 1 AND site <> ''
UNION ALL SELECT 'mirror', site, 'remove', CAST((m * 13) % 500 AS INT) FROM sites WHERE m % 16 = 5 AND site <> ''
UNION ALL SELECT 'language', host || '/de/', 'add', CAST((m * 7) % 400 AS INT) FROM hosts WHERE m % 2 = 0
"""


def oracle() -> str:
    captures, log = CAPTURES.format(pages="pages"), LOG.format(pages="pages")
    return f"""
WITH captures AS ({captures}), entry AS ({log}),
days AS (SELECT list, pattern, day, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS off FROM entry GROUP BY list, pattern, day),
placed AS (SELECT row_number() OVER () AS rid, page_id, fetched, nullif(regexp_extract(lower(url), '{ADDRESS}', 1), '') AS host,
  regexp_extract(lower(url), '{ADDRESS}', 2) AS segment FROM captures),
latest AS (SELECT p.rid, d.list, d.pattern, arg_max(d.off, d.day) AS off FROM placed p JOIN days d ON d.day <= p.fetched
  AND (d.pattern = p.host OR ends_with(p.host, '.' || d.pattern) OR d.pattern = p.host || p.segment AND p.segment <> '') GROUP BY ALL),
met AS (SELECT rid, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n FROM latest WHERE off = 0 GROUP BY rid)
SELECT page_id, host, fetched, coalesce(lists, '') AS lists, coalesce(n, 0) AS n_entries, n IS NOT NULL AS blocked
FROM placed LEFT JOIN met USING (rid)
"""
