"""License scans by a positional index of rare tokens.

A template is a short license wording; its postings say which word stands at which place. A scan works inside a row:

1. the words of a text that are *anchors*, the rarest mandatory word of some template by inverse document frequency over all
   texts, are found in one pass over its words, with their positions;
2. the posting of an anchor turns a position into the start of an alignment; an alignment lives on only if the second
   rarest stands at the place the postings ask for (rare positions first, so few texts get further);
3. an alignment is accepted if every mandatory key phrase stands where the template has it and the words that agree, weighted
   by their inverse document frequency, reach ``least`` of the template's weight.

Word frequencies are partial sums per vocabulary word; the vocabulary is that of the templates, so what reaches the driver
has a fixed size. Texts never move: no shuffle of texts, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm.shared import bind, lower_ascii, words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A wording in lower case and the phrases of it that must stand; ``base`` templates are exact short phrases."""

    label: str
    wording: str
    phrases: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.wording.split()

    def places(self) -> list[tuple[int, list[str]]]:
        """(first place in the wording, words) of each mandatory phrase."""
        own = self.words
        found = []
        for phrase in self.phrases:
            p = phrase.split()
            found.append((next(i for i in range(len(own)) if own[i : i + len(p)] == p), p))
        return found

    def anchors(self, idf: dict[str, float]) -> list[int]:
        """Places of the mandatory words, rarest first: every acceptable alignment has them, so none is lost."""
        own = self.words
        return sorted({place + k for place, phrase in self.places() for k in range(len(phrase))}, key=lambda i: (-idf[own[i]], i))


# Wordings of public licenses.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "apache license version 2 0", ("apache license", "version 2 0")),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license", "version 2")),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license", "version 3")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl-3.0", "gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "binary forms")),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    Template("cc-by", "cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "cc by nc 4 0", ("cc by nc",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("public domain dedication",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def document_frequencies(text_words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of texts, and in how many each vocabulary word stands; ``text_words`` has one column ``words``."""
    vocab = F.array(*map(F.lit, vocabulary(templates)))
    found = text_words.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", vocab))).alias("word"))
    counts = {r.word: r["count"] for r in found.groupBy("word").count().collect()}
    return counts.pop("", 0), counts


def inverse_frequencies(n: int, counts: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1.0 for w in vocabulary(templates)}


def _alignments(anchors: Column, text: Column, template: Template, idf: dict[str, float], least: float) -> Column:
    """array<struct<start, score, base, label>> of accepted alignments; ``anchors`` has (word, position) of a text."""
    own = template.words
    order = template.anchors(idf)
    first, second = order[0], order[min(1, len(order) - 1)]
    total = sum(idf[w] for w in own)
    # Places of the text are 1-based; a start below 1 gives null and drops out.
    starts = F.transform(F.filter(anchors, lambda a: a["w"] == own[first]), lambda a: a["p"] - first)

    def at(start: Column, i: int) -> Column:
        return F.coalesce(F.try_element_at(text, (start + i).cast("int")) == own[i], F.lit(False))

    aligned = F.filter(starts, lambda s: (s >= 1) & at(s, second))
    phrased = aligned
    for place, phrase in template.places():
        for k in range(len(phrase)):
            if place + k not in (first, second):
                phrased = F.filter(phrased, lambda s: at(s, place + k))  # noqa: B023  (called at once)

    def scored(s: Column) -> Column:
        weight = F.lit(0.0)
        for i, w in enumerate(own):
            weight = weight + F.when(at(s, i), F.lit(idf[w])).otherwise(0.0)
        return F.struct((s - 1).cast("long").alias("start"), (weight / F.lit(total)).alias("score"),
                        F.lit(template.base).alias("base"), F.lit(template.label).alias("label"))

    return F.filter(F.transform(phrased, scored), lambda x: x["score"] >= least)


def scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """``docs`` with ``license_words`` (number of words) and ``license_hits``: accepted alignments (start, score, base, label).

    Null and empty texts have no words and no hits; rows are neither merged nor dropped, whatever their ids. Columns of
    these two names are replaced.
    """
    split = words(lower_ascii(F.col(text)), SEPARATORS)
    n, counts = document_frequencies(docs.select(split.alias("words")), templates)
    idf = inverse_frequencies(n, counts, templates)
    keys = sorted({t.words[t.anchors(idf)[0]] for t in templates})

    def hits(w: Column) -> Column:
        placed = F.filter(F.transform(w, lambda x, i: F.when(x.isin(keys), F.struct(x.alias("w"), (i + 1).alias("p")))), lambda a: a.isNotNull())
        return bind(placed, lambda a: F.when(F.size(a) > 0, F.concat(*[_alignments(a, w, t, idf, least) for t in templates])))

    found = bind(split, lambda w: F.struct(F.size(w).cast("long").alias("n"), hits(w).alias("h")))
    return docs.withColumn("_scan", found).withColumns({"license_words": F.col("_scan.n"), "license_hits": F.col("_scan.h")}).drop("_scan")


def summary(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per row: doc_id, n_words, base places and labels, all labels and the best score (0 without a hit)."""
    hits = F.coalesce("license_hits", F.expr("array()").cast("array<struct<start:bigint,score:double,base:boolean,label:string>>"))
    out = scanned.select(F.col(doc_id).alias("doc_id"), F.col("license_words").alias("n_words"), hits.alias("_h"))
    base = F.filter("_h", lambda x: x["base"])
    labels = lambda h: F.array_join(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"])
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("_h")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("_h", lambda x: x["score"])), F.lit(0.0)), 6).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, least: float = 0.8) -> str:
    """The same rows by comparing every template with every place of every text."""
    rows = ", ".join(
        f"({k}, '{t.label}', {str(t.base).lower()}, {i}, '{w}', {str(any(p <= i < p + len(q) for p, q in t.places())).lower()})"
        for k, t in enumerate(templates) for i, w in enumerate(t.words)
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
tokens AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
template(k, label, base, i, word, fixed) AS (VALUES {rows}),
frequency AS (SELECT v.word, ln(((SELECT count(*) FROM docs) + 1) / (count(DISTINCT t.rid) + 1)) + 1.0 AS idf
  FROM (SELECT DISTINCT word FROM template) v LEFT JOIN tokens t USING (word) GROUP BY v.word),
weighed AS (SELECT t.*, f.idf FROM template t JOIN frequency f USING (word)),
total AS (SELECT k, sum(idf) AS idf, sum(CASE WHEN fixed THEN 1 ELSE 0 END) AS fixed FROM weighed GROUP BY k),
lead AS (SELECT k, arg_min(i, (-idf, i)) AS a,  arg_min(i, (-idf, i), 2)[least(2, count(*))] AS b FROM weighed WHERE fixed GROUP BY k),
starts AS (SELECT t.rid, w.k, t.p - w.i AS start, sum(w.idf) AS idf, sum(CASE WHEN w.fixed THEN 1 ELSE 0 END) AS fixed,
    bool_or(w.i = l.a) AND bool_or(w.i = l.b) AS led
  FROM tokens t JOIN weighed w USING (word) JOIN lead l ON l.k = w.k WHERE t.p >= w.i GROUP BY t.rid, w.k, t.p - w.i),
hits AS (SELECT s.rid, s.start, s.idf / n.idf AS score, x.base, x.label FROM starts s JOIN total n ON n.k = s.k
  JOIN (SELECT DISTINCT k, label, base FROM template) x ON x.k = s.k
  WHERE s.led AND s.fixed = n.fixed AND s.idf / n.idf >= {least} - 1e-12)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(h.rid) FILTER (WHERE h.base) AS n_base,
  min(h.start) FILTER (WHERE h.base) AS first_word, max(h.start) FILTER (WHERE h.base) AS last_word,
  coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label) FILTER (WHERE h.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT h.label, ',' ORDER BY h.label), '') AS labels, round(coalesce(max(h.score), 0.0), 6) AS score
FROM docs d LEFT JOIN hits h USING (rid) GROUP BY d.rid, d.doc_id
"""
