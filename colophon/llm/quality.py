"""Quality rules whose cutoffs carry a guarantee.

Every rule is a figure that grows with junk. All rules share one scale of cutoffs from mild to strict; at a *level* of the scale a
document is rejected if any of its figures is above that cutoff, so what stricter levels reject grows with the level.
Labelled documents of good quality are the holdout: per stratum (a listed language, or ``other``), a level is *safe* if the
exact binomial (Clopper-Pearson) bound says that it rejects at most ``risk`` of the good documents, all rules together. Each
stratum walks the levels from mild to strict and stops at the first that isn't safe (fixed-sequence testing, so the walk itself
costs nothing); the strata share ``error`` by Bonferroni. So with probability 1 - ``error`` no stratum loses more than ``risk`` of
its good documents. A stratum with too few labels for any proof (77 good ones suffice at the defaults if none is rejected)
keeps its documents.

Figures are computed inside the row, once, and written; the holdout is one aggregate over labelled figures, and one cutoff per
stratum is joined back. No Python, and texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colophon.llm.shared import BLANKS, bind, words, written

STRATA = ("de", "en", "es", "fr")
GRID = (0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10, 0.08, 0.06, 0.04, 0.02)  # shares, from mild to strict
RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share")
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _repeated(w: Column, n: Column) -> Column:
    """Number of words inside five-word windows that are found twice or more."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = bind(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)])))

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda key, i: F.struct(key.alias("key"), i.alias("i"))))

        def repeated_at(s: Column) -> Column:
            same = lambda a, b: (a["key"] == b["key"])
            return F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))

        starts = bind(placed, lambda s: F.array_sort(F.transform(repeated_at(s), lambda x: x["i"])))
        return bind(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    # Most texts repeat nothing: their windows are all different and nothing needs sorting.
    return F.when(n < WINDOW, F.lit(0)).otherwise(bind(windows, lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(covered(keys))))


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the shares of the rules.

    A null text counts as empty: no words, base_failed. Columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bind(words(t), lambda w: F.struct(F.size(w).alias("n"), _repeated(w, F.size(w)).alias("repeat")))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return (
        docs.withColumns({
            "_w": of_words, "_l": of_lines, "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "_upper": F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
            "_bang": F.length(t) - F.length(F.translate(t, "!", "")),
        })
        .withColumns({
            "n_words": F.col("_w.n").cast("long"), "n_repeat_words": F.col("_w.repeat").cast("long"),
            "n_dup_lines": F.col("_l.dup").cast("long"), "_lines": F.col("_l.n"),
        })
        .withColumns({
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "_lines"),
            "repeat_share": share("n_repeat_words", "n_words"), "upper_share": share("_upper", "word_chars"),
            "bang_share": share("_bang", "n_words"),
        }).drop("_w", "_l", "_lines", "_upper", "_bang")
    )


def stratum(lang: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise("other")


def below(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n draws with chance p: the sum of its terms, each from the one before, in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * F.lit(math.log1p(-p))).alias("term"), F.exp(n * F.lit(math.log1p(-p))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("array()").cast("array<bigint>"))
    return F.aggregate(terms, start, step)["sum"]


def safe_cutoffs(labelled: DataFrame, risk: float = 0.05, error: float = 0.1, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """(stratum, cutoff): the strictest safe cutoff of each stratum; ``labelled`` has stratum, the shares and quality (0/1)."""
    worst = F.greatest(*[F.col(r) for r in RULES])  # a document is rejected below its largest share
    cells = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for i, c in enumerate(GRID)])
    counts = (
        labelled.filter("quality = 1").select("stratum", worst.alias("worst"), F.explode(cells).alias("c")).select("stratum", "worst", "c.*")
        .groupBy("stratum", "step", "cutoff").agg(F.count("*").alias("n"), F.sum((F.col("worst") > F.col("cutoff")).cast("long")).alias("k"))
    )
    # The bound is below risk exactly when so few rejections would be rare at that risk. Beyond the mean they are not.
    chance = F.when(F.col("k") >= F.col("n") * risk, F.lit(1.0)).otherwise(below(F.col("k"), F.col("n"), risk))
    walk = W.partitionBy("stratum").orderBy("step")
    tested = counts.withColumn("safe", (chance <= error / (len(strata) + 1)).cast("int")).withColumn("safe", F.min("safe").over(walk))
    return tested.filter("safe = 1").groupBy("stratum").agg(F.min("cutoff").alias("cutoff"))


def verdicts(figured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.1, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """``figured`` with ``failed_rules`` (array of names) and ``kept``; ``figured`` has doc_id, lang and figures, read twice.

    Labels without id or quality are ignored; an id with several labels is good if one says so. A null or unlisted language
    is in the stratum ``other``.
    """
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    with_stratum = figured.withColumn("stratum", stratum(F.col("lang"), strata))
    cutoffs = safe_cutoffs(with_stratum.select("doc_id", "stratum", *RULES).join(good, "doc_id"), risk, error, strata)
    # One row per stratum, of which there are len(strata) + 1 at most: a bounded broadcast.
    joined = with_stratum.join(F.broadcast(cutoffs.withColumnRenamed("cutoff", "_cutoff")), "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col("_cutoff"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_cutoff")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.1) -> DataFrame:
    """doc_id, the base figures, kept, stratum and failed_rules for every row of ``docs`` (doc_id, text, lang)."""
    kept = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *RULES]
    figured = written(figures(docs.select("doc_id", "text", "lang")).select(*kept), "quality_figures")
    return verdicts(figured, labels, risk, error)


def oracle(risk: float = 0.05, error: float = 0.1) -> str:
    tests = len(STRATA) + 1
    strata = ", ".join(f"'{s}'" for s in STRATA)
    fails = " OR ".join(f"coalesce(f.{r} > c.cutoff, false)" for r in RULES)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum FROM documents),
split AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
grams AS (SELECT rid, p, w[p:p + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM split)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT q) AS c FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY rid),
figures AS (SELECT d.rid, d.doc_id, d.stratum, len(s.w) AS n_words, length(regexp_replace(d.t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(s.l) - len(list_distinct(s.l)) AS n_dup_lines, len(s.l) AS n_lines,
  coalesce(r.c, 0) AS n_repeat_words, length(regexp_replace(d.t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(d.t, '[^!]', '', 'g')) AS bang
  FROM docs d JOIN split s USING (rid) LEFT JOIN repeats r USING (rid)),
shares AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share,
  n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
  upper / greatest(word_chars, 1) AS upper_share, bang / greatest(n_words, 1) AS bang_share FROM figures),
labelled AS (SELECT s.* FROM shares s JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id) WHERE quality = 1),
counts AS (SELECT stratum, cutoff, count(*) AS n, count(*) FILTER (WHERE greatest({', '.join(RULES)}) > cutoff) AS k
  FROM labelled, (SELECT unnest([{', '.join(map(str, GRID))}]) AS cutoff) g GROUP BY ALL),
chances AS (SELECT stratum, cutoff, CASE WHEN k >= n * {risk} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END AS chance FROM counts),
walk AS (SELECT *, max(chance) OVER (PARTITION BY stratum ORDER BY cutoff DESC) <= {error / tests} AS safe FROM chances),
cutoffs AS (SELECT stratum, min(cutoff) AS cutoff FROM walk WHERE safe GROUP BY stratum)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({fails}) AS kept
FROM shares f LEFT JOIN cutoffs c USING (stratum)
"""
