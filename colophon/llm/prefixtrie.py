"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation becomes rows of ``WIDTH`` turn columns t1, t2, ...; one ``GROUP BY prior node, ROLLUP (t1, ...)`` per pass
aggregates every prefix of every block at once, and ``grouping_id`` tells its depth. Longer conversations continue in
further rows, keyed by the node in which the block before ends, so all blocks of all depths are one aggregation and no step
walks the tree.

A node is named by its depth and the exclusive or of 128-bit hashes of its turns, each taken with its position. Unlike a
chained hash that can be summed up in parts: a conversation of any length is spread over tasks (ranges of ``RANGE`` turn
numbers or blocks, then one row per range). Two of 10^12 different nodes share a name with a chance of about 10^-15.

Subtree sums need no walk either. Every node belongs to its smallest member, and a member owns the lower end of its path;
so a sum over a subtree is a sum over the node's members of what each of them owns, which is the second ROLLUP.

Edge cases: turns of equal number are ordered by role, then text; null roles and texts are empty; rows without conversation
id belong to none; repeated rows are turns of their own; an empty table has no node, not even a root; other columns are not
read. A digest of member ids is one sequential hash by definition: ids are sorted by Spark and streamed, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.llm.shared import written

WIDTH, RANGE = 8, 256
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
NODE = ["depth", "a", "b"]


def digest(role: Column, text: Column) -> Column:
    """Binary of 16 bytes for a turn; the length of the role keeps role and text apart."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn (digest), n_bytes of every turn; ranges of turn numbers are counted apart, then added up."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.col("turn").alias("no"), role.alias("role"), text.alias("text"),
        F.coalesce(F.floor(F.col("turn") / RANGE).cast("long"), F.lit(-(1 << 62))).alias("part"),
    )
    inside = W.partitionBy("conv_id", "part").orderBy(F.col("no").asc_nulls_first(), "role", "text")
    placed = rows.select(
        "conv_id", "part", F.row_number().over(inside).alias("at"), digest(F.col("role"), F.col("text")).alias("turn"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    placed = written(placed, "turns")
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before")
    pos = (F.col("at") + F.coalesce("before", F.lit(0))).cast("long")
    return placed.join(later, ["conv_id", "part"], "left").select("conv_id", pos.alias("pos"), "turn", "n_bytes")


def with_openings(turns: DataFrame, group: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where conversation c opens with the first h turns of c - c % group, then goes on with its own
    after the first h; h = crc32 of the decimal c modulo ``longest`` + 1."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest + 1))
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = lengths.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = lengths.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    same = F.col("conv_id") == F.col("base")
    plan = plan.join(bases, "base", "left").select(
        "conv_id", "base", "n", F.when(same, 0).otherwise(F.col("h")).alias("h"),
        F.when(same, 0).otherwise(F.least("h", F.coalesce("base_n", F.lit(0)))).alias("taken"),
    )
    plan = written(plan, "plan")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "n_bytes")
    heads = turns.filter((F.col("pos") <= longest) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    taken = heads.join(plan.filter("taken > 0").select("conv_id", "base", "taken"), "base").filter("pos <= taken")
    return own.unionByName(taken.select("conv_id", "pos", "turn", "n_bytes")), plan.select("conv_id")


def blocks(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation and ``WIDTH`` turns: conv_id, block, the prior node (a, b) and the bytes up to it, t1, ...

    Conversations without turns have one row without turn columns. The first row of a conversation holds its end node and all
    its bytes too.
    """
    lane = lambda seed: F.xxhash64("turn", "pos", F.lit(seed))
    slot = ((F.col("pos") - 1) % WIDTH).cast("int").alias("slot")
    tagged = turns.select("conv_id", F.floor((F.col("pos") - 1) / WIDTH).alias("block"), F.struct(slot, lane(1).alias("a"), lane(2).alias("b"), "n_bytes").alias("t"))
    rows = tagged.groupBy("conv_id", "block").agg(  # WIDTH turns at most in a group
        F.array_sort(F.collect_list("t")).alias("t"),
        F.bit_xor("t.a").alias("a"), F.bit_xor("t.b").alias("b"), F.sum("t.n_bytes").alias("n_bytes"), F.count("*").alias("n"),
    )
    rows = written(rows.withColumn("part", F.floor(F.col("block") / RANGE)), "blocks")
    ends = rows.groupBy("conv_id").agg(
        F.sum("n").alias("end_depth"), F.bit_xor("a").alias("end_a"), F.bit_xor("b").alias("end_b"), F.sum("n_bytes").alias("total")
    )
    sums = ((F.bit_xor, "a"), (F.bit_xor, "b"), (F.sum, "n_bytes"))
    before = lambda w, name: [f(c).over(w.rowsBetween(W.unboundedPreceding, -1)).alias(f"{name}_{c}") for f, c in sums]
    inside = rows.select("conv_id", "block", "part", "t", *before(W.partitionBy("conv_id", "part").orderBy("block"), "in"))
    parts = rows.groupBy("conv_id", "part").agg(*[f(c).alias(c) for f, c in sums])
    offsets = parts.select("conv_id", "part", *before(W.partitionBy("conv_id").orderBy("part"), "to")).filter("part > 0")
    both = inside.join(offsets, ["conv_id", "part"], "left")
    zero = F.lit(0).cast("long")
    prior = {c: (F.coalesce(f"in_{c}", zero), F.coalesce(f"to_{c}", zero)) for c in ("a", "b", "n_bytes")}
    pick = lambda i: F.get("t", F.lit(i))
    filled = both.select(
        "conv_id", "block", prior["a"][0].bitwiseXOR(prior["a"][1]).alias("pa"), prior["b"][0].bitwiseXOR(prior["b"][1]).alias("pb"),
        (prior["n_bytes"][0] + prior["n_bytes"][1]).alias("pn"),
        *[F.when(pick(i).isNotNull(), F.struct(*[pick(i)[c].alias(c) for c in ("a", "b", "n_bytes")])).alias(t) for i, t in enumerate(TURNS)],
    )
    bare = conversations.join(rows.filter("block = 0").select("conv_id"), "conv_id", "left_anti")
    bare = bare.select("conv_id", *[zero.alias(c) for c in ("block", "pa", "pb", "pn")])
    return filled.unionByName(bare, allowMissingColumns=True).join(ends, "conv_id", "left").fillna(0, ["end_depth", "end_a", "end_b", "total"])


def rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """depth, a, b, parent_a, parent_b, n_bytes (of its last turn), before (bytes above it) and the aggregates of every node.

    The empty prefix of a later block is the last node of the block before and is left to it.
    """
    columns = ", ".join(TURNS)
    grouped = rows.sparkSession.sql(
        f"""SELECT block, pa, pb, pn, {columns}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates}
        FROM {{rows}} GROUP BY block, pa, pb, pn, ROLLUP ({columns})""",
        rows=rows,
    )
    last = F.get(F.array(*TURNS), F.col("level") - 1)
    nodes = grouped.filter(((F.col("level") == 0) & (F.col("block") == 0)) | last.isNotNull())
    part = lambda c: [F.coalesce(F.col(t)[c], F.lit(0).cast("long")) for t in TURNS]
    both = lambda c, start: _xor([F.col(start), *part(c)])
    own = lambda c: F.coalesce(last[c], F.lit(0).cast("long"))
    a, b, n = both("a", "pa"), both("b", "pb"), sum(part("n_bytes"), F.col("pn"))
    taken = [c for c in grouped.columns if c not in ("block", "pa", "pb", "pn", "level", *TURNS)]
    return nodes.select(
        (F.col("block") * WIDTH + F.col("level")).cast("long").alias("depth"), a.alias("a"), b.alias("b"),
        a.bitwiseXOR(own("a")).alias("parent_a"), b.bitwiseXOR(own("b")).alias("parent_b"), own("n_bytes").alias("n_bytes"),
        (n - own("n_bytes")).alias("before"), *taken,
    )


def _xor(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total.bitwiseXOR(c)
    return total


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the decimal ids of the conversations that end in a node, ascending, comma-joined."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def packed(found: list) -> pa.RecordBatch:
            arrays = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([f[3] for f in found], pa.string())], names=[*NODE, "ends_sha256"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            ids = batch.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            found = []
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                key = tuple(keys[start].tolist())
                text = ",".join(map(str, ids[start:stop])).encode()
                if key == node:
                    state.update(b"," + text)
                else:
                    if node is not None:
                        found.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text)
            yield packed(found)
        if node is not None:
            yield packed([(*node, state.hexdigest())])

    ordered = ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return ordered.mapInArrow(stream, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over ``turns`` (conv_id, pos, turn, n_bytes) of the given conversations."""
    rows = written(blocks(turns, conversations), "rows")
    first = written(rollup(rows, "min(conv_id) AS conv_id, count(*) AS n_convs"), "nodes")
    children = first.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b"))
    nodes = first.join(children.agg(F.count("*").alias("n_children")), NODE, "left").fillna(0, ["n_children"])
    nodes = written(nodes, "nodes_with_children")
    owners = nodes.groupBy("conv_id").agg(F.sum("n_bytes").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    owned = rows.join(owners, "conv_id", "left").fillna(0, ["owned", "leaves"])
    sums = rollup(owned, "sum(total) AS total, sum(owned) AS owned, sum(leaves) AS n_leaves").select(*NODE, "before", "total", "owned", "n_leaves")
    ends = rows.filter("block = 0").select(F.col("end_depth").alias("depth"), F.col("end_a").alias("a"), F.col("end_b").alias("b"), "conv_id")
    one = rows.filter("block = 0").select("conv_id", F.col("total").alias("one_total"))
    one = one.join(owners.select("conv_id", F.col("owned").alias("one_owned")), "conv_id")
    names = nodes.select("depth", "a", "b", F.col("conv_id").alias("parent_conv_id"))
    parents = names.toDF("parent_depth", "parent_a", "parent_b", "parent_conv_id")
    # bytes of all members from here on, less those of the different nodes below: what the owner has from here on, and what
    # each other member owns
    saved = (F.col("total") - F.col("n_convs") * F.col("before")) - (F.col("owned") - F.col("one_owned") + F.col("one_total") - F.col("before"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.drop("before").withColumn("parent_depth", F.col("depth") - 1)
        .join(sums, NODE).join(one, "conv_id").join(ends_digest(ends), NODE, "left")
        .join(parents, ["parent_depth", "parent_a", "parent_b"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    )


def oracle() -> str:
    """The same nodes from whole turn lists, for an engine with nested values."""
    return """
WITH o AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce("text", ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: unicode(s)::BIGINT)),
    lambda c, s: list_reduce(list_concat([xor(c, s)], range(8)),
      lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
  FROM o
), r AS (
  SELECT c.conv_id, CASE WHEN c.conv_id % 5 = 0 THEN c.l ELSE list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) END AS p
  FROM crc c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5
), m AS (
  SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS depth FROM r
), n AS (
  SELECT p[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CASE WHEN len(p) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM m GROUP BY p[1:depth], depth
), w AS (
  SELECT n.*, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.k[1:n.depth] = n.k) AS n_children FROM n
), up AS (
  SELECT k, depth, n_convs, n_children, unnest(range(0, depth + 1)) AS above FROM w
), below AS (
  SELECT k[1:above] AS k, above AS depth, count(*) FILTER (n_children = 0) AS n_leaves,
    sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(k[depth].t)) END) AS saved_tokens
  FROM up GROUP BY k[1:above], above
)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, below.n_leaves, below.saved_tokens::BIGINT AS saved_tokens,
  sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN below ON below.depth = w.depth AND below.k = w.k
LEFT JOIN n q ON q.depth = w.depth - 1 AND q.k = w.k[1:w.depth - 1]
"""
