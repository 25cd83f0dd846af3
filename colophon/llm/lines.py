"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its ``depth`` leading tokens, then its template. Fields that
vary are generalised twice: a token with a digit, an address or a path becomes ``<*>`` by its shape, and each line also stands
under templates in which one of ``SEGMENTS`` stretches behind the leading tokens is open, so lines that differ inside one
stretch share a template whatever stands there. All templates of a line are hashes made inside its row; no line meets another
except through a shared hash, so a template of a third of all lines is a count and a smallest document, never a group.

A template *recurs* if it stands in ``min_docs`` documents or more. Lines of a recurring template are dropped from every
document but the first (lowest id, null last), so a passage survives once. Lines under ``min_tokens`` tokens are kept: short
lines agree by chance. A document is an id and a text: repeated rows of it count once and get the same lines dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm.shared import BLANK_RUN, BLANKS, bind, written

SEGMENTS = 4
LITERAL = 4  # literal tokens that a template with masks needs, beside half of the line
# Shapes of fields that vary by nature.
VARIABLE = r"[0-9]|^[a-z]+://|^www\.|@.+\.|^/.+/"
TRIGGER = r"[0-9@/]|www\."  # something that every such field has
OPEN = "<*>"


def templates(line: Column, depth: int, min_tokens: int, short: bool = False) -> Column:
    """array<long> of the template hashes of a line: the closed template first, then one per open stretch.

    A line under ``min_tokens`` has none or, with ``short``, the hash of its tokens as they are. Tokens are hashed once per
    stretch; the templates are made of the hashes of their closed stretches.
    """
    none = F.expr("array()").cast("array<bigint>")

    def tokens(t: Column) -> Column:
        # Most lines have nothing to mask: one look at the line spares one at every token.
        masked = F.when(t.rlike(TRIGGER), F.transform(_tokens(t), lambda w: F.when(w.rlike(VARIABLE), F.lit(OPEN)).otherwise(w)))
        return F.struct(_tokens(t).alias("plain"), masked.alias("masked"), (t != "").alias("filled"))

    def stretches(x: Column) -> Column:
        """struct<plain, masked, literal> per stretch (the leading tokens, then SEGMENTS); masked and literal only where masked."""
        n, rest = F.size(x["plain"]), F.size(x["plain"]) - depth
        cut = lambda k: F.floor(rest * k / SEGMENTS).cast("int") + depth
        segments = F.when(rest >= 2 * SEGMENTS, F.lit(SEGMENTS)).otherwise(1)  # closed lines are one stretch behind the lead
        bounds = [(F.lit(0), F.least(n, F.lit(depth)))] + [
            (cut(k) if k else F.lit(depth), F.when(segments == 1, n).otherwise(cut(k + 1)) if k == 0 else cut(k + 1)) for k in range(SEGMENTS)
        ]

        def each(of: Column, body) -> Column:
            first = [body(F.slice(of, lo + 1, F.greatest(hi - lo, F.lit(0)))) for lo, hi in bounds]
            return F.when(segments == 1, F.array(*first[:2])).otherwise(F.array(*first))

        literal = lambda part: F.size(F.filter(part, lambda w: w != OPEN))
        many = x["masked"].isNotNull()
        return F.struct(
            n.alias("n"), each(x["plain"], F.xxhash64).alias("plain"), F.when(many, each(x["masked"], F.xxhash64)).alias("masked"),
            F.when(many, each(x["masked"], literal)).alias("literal"),
        )

    def hashes(h: Column) -> Column:
        n = h["n"]

        def hashed(k: int, parts: int) -> Column:
            """The template with stretch ``k`` open (0: none), masked if enough of what is closed is literal."""
            closed = [j for j in range(parts) if j != k or k == 0]
            over = lambda of: F.xxhash64(n, F.lit(k), *[F.get(of, F.lit(j)) for j in closed])
            literals = sum((F.get(h["literal"], F.lit(j)) for j in closed[1:]), F.get(h["literal"], F.lit(closed[0])))
            enough = bind(literals, lambda m: (m >= LITERAL) & (2 * m >= n))
            return F.when(h["masked"].isNotNull() & enough, over(h["masked"])).otherwise(over(h["plain"]))

        # An open stretch must leave most of the line closed: at least two tokens in every other stretch.
        few, many = F.array(hashed(0, 2)), F.array(*[hashed(k, SEGMENTS + 1) for k in range(SEGMENTS + 1)])
        return F.when(F.size(h["plain"]) == 2, few).otherwise(many)

    def of_tokens(x: Column) -> Column:
        n = F.size(x["plain"])
        few = F.when(x["filled"], F.array(F.xxhash64(n, F.lit(-1), x["plain"]))).otherwise(none) if short else none
        return F.when(n < max(min_tokens, 2), few).otherwise(bind(stretches(x), hashes))

    return bind(bind(_blank_trimmed(F.lower(line)), tokens), of_tokens)


def _blank_trimmed(text: Column) -> Column:
    """All blanks as spaces, none at the ends."""
    for blank in BLANKS.replace(" ", ""):
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.btrim(text)


def _tokens(trimmed: Column) -> Column:
    """Tokens of a text as from :func:`_blank_trimmed`; an empty one has one empty token."""
    parts = F.split(trimmed, " ")
    return F.when(F.contains(trimmed, F.lit("  ")), F.filter(parts, lambda w: w != "")).otherwise(parts)


def recurring(docs: DataFrame, text: str, depth: int, min_tokens: int, min_docs: int, short: bool = False) -> DataFrame:
    """(doc, line numbers) that stand in an earlier document; ``docs`` has the document key ``_doc``."""
    lines = docs.select("_doc", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    # Hashes are made once: they are read twice below and are much smaller than the lines. They are a generated row, as a filter
    # on a plain column would be moved below it and make them a second time.
    made = lines.select("_doc", "n", F.explode(F.array(templates(F.col("line"), depth, min_tokens, short))).alias("ts"))
    hashed = written(made.filter(F.size("ts") > 0), "line_templates")
    found = hashed.select("_doc", "n", F.explode("ts").alias("t"))
    # Partial aggregates: first and last document of each template, and for min_docs over 2 the number of different ones.
    if min_docs <= 2:
        counted = found.groupBy("t").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last")).filter("first != last")
    else:
        counted = found.groupBy("t", "_doc").agg(F.lit(1).alias("one")).groupBy("t").agg(F.min("_doc").alias("first"), F.sum("one").alias("docs")).filter(F.col("docs") >= min_docs)
    later = found.join(counted.select("t", "first"), "t").filter(F.col("_doc") != F.col("first"))
    # At most the lines of one document per group.
    return later.groupBy("_doc").agg(F.collect_set("n").alias("_drop"))


def dedup(docs: DataFrame, text: str = "text", depth: int = 3, min_tokens: int = 6, min_docs: int = 2, copies: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text and more) with ``text`` without the lines that recur, ``n_lines`` and ``dropped_lines``.

    A null text stays null and has no lines; an empty line is kept. A document of recurring lines only keeps an empty text.
    No row is dropped. Columns named ``n_lines`` or ``dropped_lines`` are replaced. With ``copies``, a document with at least this
    share of its words in lines that recur, short ones included and a longer one among them, loses its recurring short lines
    too; every line keeps its first document, so no line is lost with a copy, and what is a copy's own stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("text"))
    keyed = docs.withColumn("_doc", key)
    drops = recurring(keyed.filter(F.col(text).isNotNull()).select("_doc", text), text, depth, min_tokens, min_docs, copies is not None)
    joined = keyed.join(drops, "_doc", "left")
    result = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("gone"))
    whole = lambda lines: F.struct(F.col(text).alias("text"), F.size(lines).alias("n"), F.lit(0).alias("gone"))

    def cleaned(lines: Column, gone: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)  # by hash: linear in the lines
        kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
        return F.struct(kept.alias("text"), F.size(lines).alias("n"), F.size(gone).alias("gone"))

    def judged(lines: Column) -> Column:
        if copies is None:
            return cleaned(lines, F.col("_drop"))
        words = F.transform(lines, lambda x: bind(_blank_trimmed(x), lambda t: F.when(t == "", 0).otherwise(F.size(_tokens(t)))))
        total = lambda n: F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)

        def by_words(n: Column) -> Column:
            copied = total(F.transform("_drop", lambda i: F.get(n, i))) >= copies * total(n)
            long_ones = F.filter("_drop", lambda i: F.get(n, i) >= max(min_tokens, 2))
            return bind(long_ones, lambda some: bind(F.when(copied & (F.size(some) > 0), F.col("_drop")).otherwise(some), lambda gone: cleaned(lines, gone)))

        return bind(words, by_words)

    lines = F.split(F.col(text), "\n")
    of_lines = bind(lines, lambda x: F.when(F.col("_drop").isNull(), whole(x)).otherwise(judged(x)))
    # A generated row: later filters on the result stay above it, so it is made once.
    made = joined.withColumn("_made", F.explode(F.array(F.when(F.col(text).isNull(), result).otherwise(of_lines))))
    columns = {text: F.col("_made.text"), "n_lines": F.col("_made.n").cast("long"), "dropped_lines": F.col("_made.gone").cast("long")}
    return made.withColumns(columns).drop("_doc", "_drop", "_made")


def oracle(depth: int = 3, min_tokens: int = 6) -> str:
    """The same rows with templates spelled out as text (two documents or more)."""
    # Token lists are compared as text with a separator that no token has.
    pieces = lambda of, k: " || chr(10) || ".join(
        f"array_to_string({of}[{lo}:{hi}], ' ')" for lo, hi in ([("1", str(depth)), (str(depth + 1), cut(k, depth)), (cut(k + 1, depth) + "+1", "n")] if k >= 0 else [("1", "n")])
    )
    literal = lambda k: "(len(list_filter(t, lambda x: x <> '" + OPEN + "'))" + (
        f" - len(list_filter(t[{cut(k, depth)}+1:{cut(k + 1, depth)}], lambda x: x <> '{OPEN}')))" if k >= 0 else ")")
    template = lambda k: f"CASE WHEN {literal(k)} >= {LITERAL} AND 2 * {literal(k)} >= n THEN {pieces('t', k)} ELSE {pieces('p', k)} END"
    opened = ", ".join(f"'{k + 1} ' || n || ' ' || {template(k)}" for k in range(SEGMENTS))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
numbered AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM docs),
plain AS (SELECT rid, doc_id, k, list_filter(regexp_split_to_array(lower(line), '{BLANK_RUN}'), lambda x: x <> '') AS p FROM numbered),
tokens AS (SELECT *, list_transform(p, lambda w: CASE WHEN regexp_matches(w, '{VARIABLE}') THEN '{OPEN}' ELSE w END) AS t FROM plain),
sized AS (SELECT *, len(t) AS n FROM tokens WHERE len(t) >= {min_tokens}),
found AS (SELECT rid, doc_id, k, '0 ' || {template(-1)} AS template FROM sized
  UNION ALL SELECT rid, doc_id, k, unnest([{opened}]) FROM sized WHERE n - {depth} >= {2 * SEGMENTS}),
firsts AS (SELECT template, min(doc_id) AS first FROM found GROUP BY template HAVING min(doc_id) <> max(doc_id)),
dropped AS (SELECT DISTINCT rid, k FROM found JOIN firsts USING (template) WHERE doc_id <> first),
cleaned AS (SELECT d.rid, any_value(d.doc_id) AS doc_id, count(n.k) AS n_lines, count(x.k) AS dropped_lines,
    string_agg(n.line, chr(10) ORDER BY n.k) FILTER (WHERE x.k IS NULL) AS text
  FROM docs d LEFT JOIN numbered n ON n.rid = d.rid LEFT JOIN dropped x ON x.rid = n.rid AND x.k = n.k GROUP BY d.rid)
SELECT doc_id, n_lines, dropped_lines, sha256(coalesce(text, '')) AS text_sha256 FROM cleaned
"""


def cut(k: int, depth: int) -> str:
    return f"(CAST(floor((n - {depth}) * {k} / {SEGMENTS}) AS INT) + {depth})"


def digests(deduped: DataFrame, text: str = "text") -> DataFrame:
    return deduped.select("doc_id", "n_lines", "dropped_lines", F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"))
