"""The tables a query reads, and how collection data is derived from them.

``FEEDS`` are SQL texts in the common subset of Spark SQL and ANSI SQL: a query builds its inputs from them with
Spark, and its check builds the same inputs elsewhere. Every feed covers its source tables completely.
"""

from __future__ import annotations

import hashlib
import os
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colophon.session import checkpoint_dir

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

FEEDS: dict[str, str] = {}
_STORED: dict[tuple[str, str, str], str] = {}


def needed(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


class Inputs:
    """Tables and feeds of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def feed(self, name: str) -> DataFrame:
        return self.sql(FEEDS[name])

    def spread(self, name: str) -> DataFrame:
        """A feed whose rows cost far more to work on than to read. A small packed file is one task however many rows it has,
        so the few columns that the feed reads are dealt to all tasks before any of its work."""
        return self.sql(FEEDS[name], dealt=True)

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage many queries start from, written once per application and data directory to the shared folder."""
        source = hashlib.sha256(os.path.abspath(self.sf_dir).encode()).hexdigest()[:12]
        key = (self.spark.sparkContext.applicationId, source, name)
        if key not in _STORED:
            path = f"{checkpoint_dir(self.spark)}/{key[0]}/stages/{source}/{name}"
            build().write.mode("overwrite").parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    def stored(self, name: str) -> DataFrame:
        return self.keep(name, lambda: self.spread(name))

    def sql(self, text: str, dealt: bool = False) -> DataFrame:
        """Run a text whose ``{name}`` placeholders are tables or feeds; ``dealt`` tables are spread over all tasks."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = lambda n: self.table(n).repartition(tasks) if dealt else self.table(n)
        args = {n: table(n) if n in TABLES else self.sql(FEEDS[n], dealt) for n in needed(text)}
        return self.spark.sql(text, **args)


def plain(text: str) -> str:
    """The same text for an engine where the tables are views: feeds become subqueries."""
    args = {n: n if n in TABLES else f"({plain(FEEDS[n])}) AS {n}" for n in needed(text)}
    return text.format(**args)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, feeds: list[str] | None = None):
    """Register a query over :class:`Inputs`; ``oracle`` may use its feeds as common table expressions."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if oracle is not None:
            ctes = [f"{f} AS ({plain(FEEDS[f])})" for f in feeds or []]
            body = oracle.strip()
            head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(h)), None)
            if head is not None:
                ORACLES[name] = head + ",\n".join([*ctes, body[len(head) :]])
            else:
                ORACLES[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
        return build

    return register


FEEDS["cells"] = """
WITH parts AS (
  SELECT p.*, p_partkey % 400 AS k, 'Parts ' || cast(cast(floor(p_partkey / 400) AS bigint) AS string) AS sheet FROM {part} p
), suppliers AS (
  SELECT s.*, s_suppkey % 50 AS k, 'Suppliers ' || cast(cast(floor(s_suppkey / 50) AS bigint) AS string) AS sheet FROM {supplier} s
), customers AS (
  SELECT c.*, c_custkey % 500 AS k, 'Customers ' || cast(cast(floor(c_custkey / 500) AS bigint) AS string) AS sheet FROM {customer} c
), wide AS (
  SELECT sheet, 3 + k + CASE WHEN k >= 200 THEN 1 ELSE 0 END + CASE WHEN k >= 350 THEN 1 ELSE 0 END AS row, 'P' AS kind,
    CASE WHEN p_partkey % 11 = 0 THEN '   ' ELSE ' ' || p_name || ' ' END AS c1,
    CASE WHEN p_partkey % 7 <> 3 THEN p_brand END AS c2,
    p_type AS c3,
    CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE 'RJ' || lpad(cast(p_partkey AS string), 6, '0') END AS c4,
    CASE p_partkey % 4 WHEN 0 THEN 'https://shop.example.com/item/' || cast(p_partkey AS string)
      WHEN 1 THEN 'http://nowhere' WHEN 2 THEN 'see shelf' END AS c5,
    CASE WHEN p_partkey % 13 = 0 THEN 'ask' ELSE cast(p_retailprice AS string) END AS c6,
    CASE p_partkey % 6 WHEN 0 THEN cast(1960 + p_size AS string) WHEN 1 THEN cast(1960 + p_size AS string) || '-' || cast(1 + p_size % 14 AS string)
      WHEN 2 THEN cast(1960 + p_size AS string) || '/2/' || cast(20 + p_size % 11 AS string) WHEN 3 THEN cast(30000 + p_size AS string)
      WHEN 4 THEN 'unknown' END AS c7,
    'shelf ' || cast(p_size AS string) AS c8,
    replace(p_name, ' ', '、') AS c9,
    cast(40000 + p_size * 10 AS string) AS c10
  FROM parts
  UNION ALL
  SELECT sheet, h.row, 'H' AS kind, 'タイトル', 'サークル', '作者', 'Product ID', 'URL', '価格', '発行日', NULL, 'ジャンル', 'Acquired on'
  FROM (SELECT DISTINCT sheet FROM parts) s CROSS JOIN (SELECT 2 AS row UNION ALL SELECT 203 AS row) h
  UNION ALL
  SELECT sheet, 1 + k, 'S' AS kind, s_name, 'NATION_' || cast(s_nationkey AS string), lower(s_name), cast(s_acctbal AS string),
    NULL, NULL, NULL, NULL, NULL, NULL FROM suppliers
  UNION ALL
  SELECT DISTINCT sheet, 0, 'H' AS kind, 'Title', 'Circle', 'title', 'Price', NULL, NULL, NULL, NULL, NULL, NULL FROM suppliers
  UNION ALL
  SELECT sheet, 1 + k, 'C' AS kind, c_name, c_mktsegment, cast(c_acctbal AS string), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customers
  UNION ALL
  SELECT DISTINCT sheet, 0, 'H' AS kind, 'Customer', 'Segment', 'Balance', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customers
)
SELECT 'book' AS workbook, sheet, CASE WHEN kind = 'S' OR sheet LIKE 'Suppliers%' THEN '' ELSE 'xl/' || lower(replace(sheet, ' ', '')) || '.xml' END AS sheet_key,
  cast(row AS int) AS row, cast(substr(slot, 2) AS int) AS col, text,
  CASE WHEN kind = 'P' AND slot = 'c10' THEN 1 WHEN kind = 'P' AND slot = 'c6' THEN 2 WHEN kind = 'C' AND slot = 'c3' THEN 3 ELSE 0 END AS style,
  (kind = 'P' AND slot IN ('c6', 'c10')) OR (kind = 'C' AND slot = 'c3') AS numeric
FROM (SELECT * FROM wide UNPIVOT (text FOR slot IN (c1, c2, c3, c4, c5, c6, c7, c8, c9, c10))) u
"""
