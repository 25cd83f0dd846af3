"""Linking external candidates to catalogue records by weighted evidence.

Records that normalise to the same texts are one *profile* with a number of copies, so a title shared by a
third of the catalogue is compared once. A pair can only be a match when its codes agree, or when every
dimension known on both sides is similar enough; the blocking below finds exactly those pairs (an exact
threshold join). All other pairs are NO_MATCH or INSUFFICIENT_EVIDENCE by what is blank alone, which the
collection status reads off a table of at most sixteen availability masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from colophon.functions.text import grams, normalize_code, normalize_text, similarity_of_normal, strip
from colophon.operators.numbering import written

# Fixed values of the evidence model.
WEIGHTS = {"identifier": 0.45, "title": 0.30, "circle": 0.15, "author": 0.10, "cover": 0.35}
TEXT_MATCH, TEXT_PARTIAL = 0.92, 0.60
COVER_MATCH, COVER_PARTIAL = 0.85, 0.60
LIKELY_SCORE, POSSIBLE_SCORE, AMBIGUOUS_MARGIN = 72, 50, 8
QUALITY = {"LIKELY_MATCH": 4, "POSSIBLE_MATCH": 3, "INSUFFICIENT_EVIDENCE": 2, "NO_MATCH": 1}
TEXTS = ["title", "circle", "author"]

DICE_NUM, DICE_DEN = 3, 10  # two sets of sizes m and n at Dice >= 0.6 share at least 3(m + n)/10
HOT_TOKEN = 4096  # texts of a block
SLICE_TEXTS = 512  # texts that are multiplied at once
CELL_ROWS = 1 << 17  # rows that one part of a key's matches makes


def local_products(entries: DataFrame) -> DataFrame:
    """key, title, circle, author, identifier of catalogue entries; missing texts are empty."""
    text = lambda f: F.coalesce(F.col(f"{f}.text"), F.lit(""))
    return entries.select(
        F.col("id").alias("key"), text("title").alias("title"), text("circle").alias("circle"),
        text("artist").alias("author"), text("identifier").alias("identifier"),
    )


def profiles(products: DataFrame) -> DataFrame:
    """profile, title, circle, author, code (normalised; null = not given), copies, first_key."""
    given = lambda c: F.when(strip(F.col(c)) != "", normalize_text(F.col(c))).alias(c)
    code = F.nullif(normalize_code(F.col("identifier")), F.lit("")).alias("code")
    columns = ["title", "circle", "author", "code"]
    normal = products.select("key", *[given(c) for c in TEXTS], code)
    spelled = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in columns])
    return (
        normal.groupBy(*columns).agg(F.count("*").alias("copies"), F.min("key").alias("first_key"))
        .withColumn("profile", F.md5(spelled))
    )


def profile_members(products: DataFrame) -> DataFrame:
    """key, profile: which profile a record belongs to."""
    given = lambda c: F.when(strip(F.col(c)) != "", normalize_text(F.col(c)))
    values = [given(c) for c in TEXTS] + [F.nullif(normalize_code(F.col("identifier")), F.lit(""))]
    spelled = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), v), F.lit("-")) for v in values])
    return products.select("key", F.md5(spelled).alias("profile"))


def _incidence(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bigram) of the distinct bigrams of each text, ordered by text; a bigram is two code points in one number."""
    length = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    text = np.repeat(np.arange(len(values)), length)
    same = text[1:] == text[:-1] if len(text) else np.zeros(0, dtype=bool)
    text, gram = text[1:][same], (points[:-1] << 21 | points[1:])[same]
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[new], gram[new]


def _shared(left: tuple[np.ndarray, np.ndarray], n_left: int, right: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bigrams of each text, bigrams shared with each left text) of the right texts, a slice at a time.

    Bigrams of more than a 64th of the left texts are columns of a matrix product, at most 64 times the bigrams of a text;
    the others add one to the few pairs that share them.
    """
    at, gram = left
    known, column = np.unique(gram, return_inverse=True)
    held = np.bincount(column, minlength=len(known))
    dense = np.cumsum(held > n_left / 64) - 1
    is_dense = held > n_left / 64
    matrix = np.zeros((n_left, int(is_dense.sum())), dtype=np.float32)
    chosen = is_dense[column]
    matrix[at[chosen], dense[column[chosen]]] = 1
    order = np.argsort(column, kind="stable")
    holders, ends = at[order], np.cumsum(held)
    for first in range(0, len(right), SLICE_TEXTS):
        part = right[first : first + SLICE_TEXTS]
        text, grams_ = _incidence(part)
        n = np.bincount(text, minlength=len(part))
        place = np.minimum(np.searchsorted(known, grams_), max(len(known) - 1, 0))
        hit = known[place] == grams_ if len(known) else np.zeros(len(grams_), dtype=bool)
        text, place = text[hit], place[hit]
        many = is_dense[place]
        other = np.zeros((matrix.shape[1], len(part)), dtype=np.float32)
        other[dense[place[many]], text[many]] = 1
        shared = matrix @ other  # whole numbers below 2^24: exact
        for k, j in zip(place[~many], text[~many]):
            shared[holders[ends[k] - held[k] : ends[k]], j] += 1
        yield first, n, shared


def _similar_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The pairs of two blocks of distinct texts of one kind at or above 0.6, each with its similarity."""
    columns = ["kind", "left_value", "right_value", "similarity"]
    if left.empty or right.empty:
        return pd.DataFrame({c: [] for c in columns})
    a, b = left["value"].to_numpy(dtype=object), right["value"].to_numpy(dtype=object)
    grams_a = _incidence(a.tolist())
    m = np.bincount(grams_a[0], minlength=len(a))
    position = {v: i for i, v in enumerate(a)}
    equal = [(position[v], j) for j, v in enumerate(b) if v and v in position]
    rows, places, scores = [[np.array(x, dtype=np.int64)] for x in ([i for i, _ in equal], [j for _, j in equal])] + [[np.ones(len(equal))]]
    for first, n, shared in _shared(grams_a, len(a), b.tolist()):
        # Dice at 0.6 or more, or all bigrams of one text in the other: what one text inside the other asks for
        i, j = np.nonzero((shared > 0) & ((DICE_DEN * shared >= DICE_NUM * (m[:, None] + n)) | (shared == np.minimum(m[:, None], n))))
        count = shared[i, j].astype(np.int64)
        score = 2.0 * count / (m[i] + n[j])
        for k in np.nonzero(count == np.minimum(m[i], n[j]))[0]:
            x, y = a[i[k]], b[first + j[k]]
            shorter, longer = (x, y) if len(x) <= len(y) else (y, x)
            if x == y:
                score[k] = 0.0  # found above
            elif len(shorter) >= 3 and shorter in longer:
                score[k] = 0.68 + 0.22 * (len(shorter) / len(longer))
        near = score >= TEXT_PARTIAL
        rows.append(i[near]), places.append(first + j[near]), scores.append(score[near])
    out = a[np.concatenate(rows)], b[np.concatenate(places)], np.concatenate(scores)
    return pd.DataFrame(dict(zip(columns, (left["kind"].iloc[0], *out))))


def similar_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """kind, left_value, right_value, similarity of all pairs of distinct normalised texts at or above 0.6.

    Inputs are (kind, value); only values of one kind are compared, so several columns go through one pass. A bigram is in
    many texts, so no token tells texts apart: the texts of each side are dealt to blocks by hash, and a task counts what the
    texts of two blocks share. Only texts move, once for each block of the other side, and only similar pairs leave a task.
    """
    a, b = (written(df.select("kind", "value").distinct(), name) for df, name in ((left, "left_texts"), (right, "right_texts")))
    blocks = lambda df, name: df.groupBy("kind").agg(F.ceil(F.count("*") / HOT_TOKEN).cast("int").alias(name))
    counts = written(blocks(a, "us").join(blocks(b, "vs"), "kind"), "blocks")  # one row per kind
    own = lambda n: F.pmod(F.xxhash64("value"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda df: df.join(counts, "kind")
    dealt = lambda df, u, v: of(df).withColumn("u", u).withColumn("v", v).select("kind", "value", "u", "v").groupBy("kind", "u", "v")
    cells = dealt(a, own("us"), every("vs")).cogroup(dealt(b, every("us"), own("vs")))
    return cells.applyInPandas(_similar_block, "kind string, left_value string, right_value string, similarity double")


def _comparable(df: DataFrame, key: str, side: str, *carried: str) -> DataFrame:
    """(key, kind, value, way, carried): the texts a profile may be found by.

    A circle is only asked when no title can be compared, an author when neither can. ``way`` spells for each
    earlier text whose blank is to blame: the candidate's (c), or the local's alone (l). A pair has one way.
    """
    found = []
    for depth, text in enumerate(TEXTS):
        for way in ("".join(w) for w in product("cl", repeat=depth)):
            allowed = F.col(text).isNotNull()
            for earlier, blame in zip(TEXTS, way):
                if side == "c":
                    allowed &= F.col(earlier).isNull() if blame == "c" else F.col(earlier).isNotNull()
                elif blame == "l":
                    allowed &= F.col(earlier).isNull()
            found.append(F.when(allowed, F.struct(F.lit(text).alias("kind"), F.col(text).alias("value"), F.lit(way).alias("way"))))
    return df.select(F.col("profile").alias(key), F.explode(F.array_compact(F.array(*found))).alias("f"), *carried).select(key, "f.*", *carried)


def _values(df: DataFrame) -> DataFrame:
    """kind, value of all texts."""
    given = F.array_compact(F.array(*[F.when(F.col(t).isNotNull(), F.struct(F.lit(t).alias("kind"), F.col(t).alias("value"))) for t in TEXTS]))
    return df.select(F.explode(given).alias("f")).select("f.*").distinct()


def block_pairs(candidates: DataFrame, locals_: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """c, l: the profile pairs that may be a match. covers: c, l, cover_similarity.

    Equal codes; similar titles; where no title can be compared, similar circles; where neither can, similar
    authors; and every pair with a supplied cover similarity.
    """
    x, y = _comparable(candidates, "c", "c"), _comparable(locals_, "l", "l")
    near = similar_texts(x, y).select("kind", "left_value", "right_value")
    same_text = (
        x.withColumnRenamed("value", "left_value").join(near, ["kind", "left_value"])
        .join(y.withColumnRenamed("value", "right_value"), ["kind", "right_value", "way"]).select("c", "l")
    )
    return same_text.unionByName(_named_pairs(candidates, locals_, covers)).distinct()


def _named_pairs(candidates: DataFrame, locals_: DataFrame, covers: DataFrame | None) -> DataFrame:
    """c, l of equal codes or with a supplied cover similarity."""
    coded = lambda df, key: df.filter("code IS NOT NULL").select(F.col("profile").alias(key), "code")
    same_code = coded(candidates, "c").join(coded(locals_, "l"), "code").select("c", "l")
    return same_code if covers is None else same_code.unionByName(covers.select("c", "l")).distinct()


def pair_evidence(
    pairs: DataFrame, candidates: DataFrame, locals_: DataFrame, covers: DataFrame | None = None
) -> DataFrame:
    """c, l and an evidence array of struct<dimension,state,weight,similarity>; blank on either side is UNKNOWN."""
    attrs = ["code", *TEXTS]

    def side(df: DataFrame, key: str) -> DataFrame:
        return df.select(
            F.col("profile").alias(key), *[F.col(a).alias(f"{key}_{a}") for a in attrs],
            *[grams(F.col(t), 2).alias(f"{key}_{t}_g") for t in TEXTS],
        )

    joined = pairs.join(side(candidates, "c"), "c").join(side(locals_, "l"), "l")
    joined = (
        joined.join(covers.select("c", "l", "cover_similarity"), ["c", "l"], "left") if covers is not None
        else joined.withColumn("cover_similarity", F.lit(None).cast("double"))
    )
    codes = F.col("c_code").isNotNull() & F.col("l_code").isNotNull()
    scores = {"identifier": F.when(codes, (F.col("c_code") == F.col("l_code")).cast("double"))}
    for t in TEXTS:
        x, y = F.col(f"c_{t}"), F.col(f"l_{t}")
        scores[t] = F.when(
            x.isNotNull() & y.isNotNull(), similarity_of_normal(x, y, F.col(f"c_{t}_g"), F.col(f"l_{t}_g"))
        )
    scores["cover"] = F.least(F.greatest(F.col("cover_similarity"), F.lit(0.0)), F.lit(1.0))
    scores["cover"] = F.when(F.col("cover_similarity").isNotNull(), scores["cover"])
    return joined.select("c", "l", _evidence(scores).alias("evidence"))


def _evidence(scores: dict[str, Column]) -> Column:
    """Array of struct<dimension,state,weight,similarity> from a similarity (or null) per dimension."""

    def state(d: str) -> Column:
        match, partial = {"identifier": (1.0, 1.0), "cover": (COVER_MATCH, COVER_PARTIAL)}.get(d, (TEXT_MATCH, TEXT_PARTIAL))
        s = scores[d]
        return F.when(s.isNull(), "UNKNOWN").when(s >= match, "MATCH").when(s >= partial, "PARTIAL").otherwise("MISMATCH")

    return F.array(*[
        F.struct(F.lit(d).alias("dimension"), state(d).alias("state"), F.lit(w).alias("weight"), scores[d].alias("similarity"))
        for d, w in WEIGHTS.items()
    ])


def pair_verdict(evidence: DataFrame) -> DataFrame:
    """Adds score (0..100) and verdict to rows with an evidence array."""
    at = {d: F.col("evidence")[i] for i, d in enumerate(WEIGHTS)}
    zero = F.lit(0.0)
    known = lambda e: e["state"] != "UNKNOWN"
    weighted = reduce(lambda a, b: a + b, [F.when(known(e), e["weight"] * e["similarity"]).otherwise(zero) for e in at.values()])
    total = reduce(lambda a, b: a + b, [F.when(known(e), e["weight"]).otherwise(zero) for e in at.values()])
    out = evidence.withColumn("known_weight", total).withColumn(
        "score", F.when(total > 0, F.floor(weighted / total * 100)).otherwise(0).cast("int")
    )
    contradicted = F.exists("evidence", lambda e: e["state"] == "MISMATCH")
    corroborated = reduce(lambda a, b: a | b, [at[d]["state"] == "MATCH" for d in ("circle", "author", "cover")])
    verdict = (
        F.when(F.col("known_weight") == 0, "INSUFFICIENT_EVIDENCE")
        .when(at["identifier"]["state"] == "MATCH", "LIKELY_MATCH")
        .when(contradicted, "NO_MATCH")
        .when((F.col("score") >= LIKELY_SCORE) & (at["title"]["state"] == "MATCH") & corroborated, "LIKELY_MATCH")
        .when(F.col("score") >= POSSIBLE_SCORE, "POSSIBLE_MATCH")
        .otherwise("NO_MATCH")
    )
    return out.withColumn("verdict", verdict).drop("known_weight")


def quality(verdict: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(verdict == kv[0], kv[1]), QUALITY.items(), F.when(F.lit(False), 0))


def text_views(locals_: DataFrame) -> DataFrame:
    """profile -> view: local profiles that differ in their code only are one view to a candidate without that code."""
    coded = F.col("code").isNotNull()
    spelled = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in TEXTS], coded.cast("string"))
    return locals_.select("profile", *TEXTS, coded.alias("coded"), "copies", "first_key", F.md5(spelled).alias("view"))


def _dealt_join(left: DataFrame, right: DataFrame, key: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """The equality join of few bytes that make many rows: tasks are dealt by rows made, not by bytes read.

    Of a key that makes more than ``cell_rows`` rows the larger side is cut into parts, each met by the whole other side.
    Numbers of tasks are given: by size alone the join would be left to one or two.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = written(left, "dealt_left"), written(right, "dealt_right")
    sizes = [df.groupBy(*key).agg(F.count("*").cast("double").alias(name)) for df, name in ((left, "_x"), (right, "_y"))]
    parts = F.ceil(F.col("_x") * F.col("_y") / cell_rows).cast("int")
    hot = sizes[0].join(sizes[1], key).select(*key, parts.alias("_parts"), (F.col("_x") >= F.col("_y")).alias("_cut_left")).filter("_parts > 1")
    hot = written(hot, "hot")

    def side(df: DataFrame, cut: Column, named: list[str]) -> DataFrame:
        own = F.array(F.pmod(F.xxhash64(*named), F.col("_parts")).cast("int"))
        cells = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(cut, own).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        return df.join(hot, key, "left").withColumn("_part", F.explode(cells)).drop("_parts", "_cut_left").repartition(tasks, *key, "_part")

    a = side(left, F.col("_cut_left"), [c for c in left.columns if c not in key])
    b = side(right, ~F.col("_cut_left"), [c for c in right.columns if c not in key])
    return a.join(b, [*key, "_part"]).drop("_part")


def match_views(candidates: DataFrame, locals_: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """c, view, l, score, verdict, n, copies, first_key, evidence: all matches, those by text alone folded to views of ``n`` profiles.

    A candidate meets every view once, by the similarities of distinct texts, which are found once for all. Where both have a
    code the pair is decided by it and meets by it. Pairs of equal codes or with a cover similarity are rows of their own
    (``l`` instead of ``view``) and are taken off their view. covers: c, l, cover_similarity, one row per pair.
    """
    members = text_views(locals_)
    views = members.groupBy("view", *TEXTS, "coded").agg(
        F.count("*").alias("n"), F.sum("copies").alias("copies"), F.min("first_key").alias("first_key")
    )
    near = written(similar_texts(_values(candidates), _values(locals_)), "similar_texts")  # looked up three times
    x = _comparable(candidates.withColumn("c_coded", F.col("code").isNotNull()), "c", "c", "circle", "author", "c_coded")
    y = _comparable(views.withColumnRenamed("view", "profile"), "view", "l", "circle", "author", "coded", "n", "copies", "first_key")
    x = x.select("c", "kind", "way", F.col("value").alias("left_value"), F.col("circle").alias("c_circle"), F.col("author").alias("c_author"), "c_coded")
    y = y.withColumnRenamed("value", "right_value").withColumnsRenamed({"circle": "l_circle", "author": "l_author"})
    met = _dealt_join(x.join(near, ["kind", "left_value"]), y, ["kind", "right_value", "way"]).filter(~(F.col("c_coded") & F.col("coded")))
    for text in ("circle", "author"):
        known = near.filter(F.col("kind") == text).select(
            F.col("left_value").alias(f"c_{text}"), F.col("right_value").alias(f"l_{text}"), F.col("similarity").alias(f"s_{text}")
        )
        both = F.col(f"c_{text}").isNotNull() & F.col(f"l_{text}").isNotNull()
        met = met.join(known, [f"c_{text}", f"l_{text}"], "left").filter(~both | F.col(f"s_{text}").isNotNull())
    none = F.lit(None).cast("double")
    scores = {"identifier": none, "title": F.when(F.col("kind") == "title", F.col("similarity")), "circle": F.col("s_circle"), "author": F.col("s_author"), "cover": none}
    columns = ["c", "view", "l", "score", "verdict", "n", "copies", "first_key", "evidence"]
    is_match = F.col("verdict").isin("LIKELY_MATCH", "POSSIBLE_MATCH")
    by_text = pair_verdict(met.withColumn("evidence", _evidence(scores))).filter(is_match).withColumn("l", F.lit(None).cast("string"))
    if covers is not None:
        by_text = _without_covered(by_text, members, covers)
    named = _named_pairs(candidates, locals_, covers)
    own = pair_verdict(pair_evidence(named, candidates, locals_, covers)).filter(is_match)
    own = own.join(locals_.select(F.col("profile").alias("l"), "copies", "first_key"), "l").withColumns(
        {"n": F.lit(1).cast("long"), "view": F.lit(None).cast("string")}
    )
    return by_text.select(columns).unionByName(own.select(columns))


def _without_covered(by_text: DataFrame, members: DataFrame, covers: DataFrame) -> DataFrame:
    """Views less the profiles that a candidate has a cover similarity for; only where its first key goes is it sought anew."""
    pairs = covers.select("c", "l").join(members.select(F.col("profile").alias("l"), "view", F.col("copies").alias("k"), F.col("first_key").alias("f")), "l")
    gone = pairs.groupBy("c", "view").agg(F.count("*").alias("gone"), F.sum("k").alias("gone_copies"), F.min("f").alias("gone_key"))
    firsts = members.groupBy("view").agg(F.min("first_key").alias("first_key"))
    first_gone = gone.join(firsts, "view").filter(F.col("gone_key") == F.col("first_key")).select("c", "view")
    anew = (
        first_gone.join(members.select("view", F.col("profile").alias("l"), F.col("first_key").alias("f")), "view")
        .join(covers.select("c", "l"), ["c", "l"], "left_anti").groupBy("c", "view").agg(F.min("f").alias("next_key"))
    )
    marks = written(gone.drop("gone_key").join(anew, ["c", "view"], "left"), "covered_views")  # the matches are made and joined once
    left = by_text.join(marks, ["c", "view"], "left").filter(F.col("gone").isNull() | (F.col("n") > F.col("gone")))
    return left.withColumns({
        "n": F.col("n") - F.coalesce("gone", F.lit(0)), "copies": F.col("copies") - F.coalesce("gone_copies", F.lit(0)),
        "first_key": F.coalesce("next_key", "first_key"),
    })


def spelled_out(matches: DataFrame, locals_: DataFrame, covers: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """c, l, score, verdict, copies, first_key: the profiles of rows as from :func:`match_views`, one row each.

    ``more`` names columns of the matches that their profiles keep: evidence is the same for all profiles of a view.
    """
    columns = ["c", "l", "score", "verdict", "copies", "first_key", *more]
    members = text_views(locals_).select("view", F.col("profile").alias("l"), "copies", "first_key")
    views = matches.filter("view IS NOT NULL").select("c", "view", "score", "verdict", *more)
    if covers is None:
        by_text = views.join(members, "view")
    else:
        # Only profiles of views that hold a pair with a cover are looked up; all others never move once they are spelled out.
        held = covers.select("c", "l").join(members.select("l", "view"), "l").select("c", "view").distinct().withColumn("_held", F.lit(True))
        marked = views.join(held, ["c", "view"], "left")
        looked_up = marked.filter("_held").drop("_held").join(members, "view").join(covers.select("c", "l"), ["c", "l"], "left_anti")
        free = marked.filter("_held IS NULL").drop("_held").join(members, "view")
        by_text = free.select(columns).unionByName(looked_up.select(columns))
    return by_text.select(columns).unionByName(matches.filter("l IS NOT NULL").select(columns))


def match_profiles(candidates: DataFrame, locals_: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """Blocking, evidence and verdict of two product tables' profiles; keeps the matches.

    c, l, score, verdict, copies, first_key. Every match is a row; :func:`match_states` has one row per candidate.
    """
    return spelled_out(match_views(candidates, locals_, covers), locals_, covers)


def rank_matches(matches: DataFrame) -> DataFrame:
    """Matches in rank order: verdict quality, score, then key. A range sort, so one busy candidate can spread."""
    return matches.orderBy("c", F.desc(quality(F.col("verdict"))), F.desc("score"), "first_key")


def match_states(views: DataFrame, margin: int = AMBIGUOUS_MARGIN) -> DataFrame:
    """c, verdict, score, first_key of the first-ranked match, near and near_copies within ``margin`` points of its score, rest.

    Mergeable and bounded: partial results are counts per verdict and whole score, at most 202 a candidate, whatever the
    number of its matches. ``near`` counts profiles, ``near_copies`` records, ``rest`` the profiles further off.
    """
    counts = views.groupBy("c", "verdict", "score").agg(
        F.sum("n").alias("n"), F.sum("copies").alias("copies"), F.min("first_key").alias("first_key")
    )
    place = F.struct((-quality(F.col("verdict"))).alias("q"), (-F.col("score")).alias("s"), "first_key", "verdict", "score", "n", "copies")
    state = counts.groupBy("c").agg(F.collect_list(place).alias("all"))
    best = state.select("c", "all", F.array_min("all").alias("b"))
    close = F.filter("all", lambda m: F.col("b.score") - m["score"] <= margin)
    far = F.filter("all", lambda m: F.col("b.score") - m["score"] > margin)
    total = lambda found, f: F.aggregate(found, F.lit(0).cast("long"), lambda acc, m: acc + m[f])
    return best.select(
        "c", "b.verdict", "b.score", "b.first_key", total(close, "n").alias("near"), total(close, "copies").alias("near_copies"), total(far, "n").alias("rest")
    )


def best_matches(states: DataFrame) -> DataFrame:
    """c, verdict, score, first_key of the first-ranked match of each candidate profile."""
    return states.select("c", "verdict", "score", "first_key")


def ambiguous_matches(
    views: DataFrame, states: DataFrame, locals_: DataFrame, covers: DataFrame | None = None, margin: int = AMBIGUOUS_MARGIN
) -> DataFrame:
    """Matches within ``margin`` points of their candidate's first-ranked one, one row each; views further off are never spelled out."""
    best = states.select("c", F.col("score").alias("best_score"))
    close = views.join(best, "c").filter(F.col("best_score") - F.col("score") <= margin)
    return spelled_out(close, locals_, covers)


def _mask(df: DataFrame) -> Column:
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(["code", *TEXTS])]
    return reduce(lambda a, b: a + b, bits)


def collection_status(candidates: DataFrame, locals_: DataFrame, states: DataFrame) -> DataFrame:
    """profile, catalogued MATCHED|AMBIGUOUS|ABSENT|UNKNOWN per candidate profile, from its match state.

    Without a match the answer depends on what is blank: a record nothing can be compared with leaves the
    question open, otherwise the product is absent. An empty catalogue knows nothing.
    """
    masks = locals_.select(_mask(locals_).alias("mask")).distinct()  # at most sixteen rows
    masks = masks.agg(F.collect_set("mask").alias("masks")).withColumn("one", F.lit(1))
    joined = candidates.withColumn("mask", _mask(candidates)).withColumn("one", F.lit(1)).join(
        states.select("c", "verdict", "near_copies"), F.col("profile") == F.col("c"), "left"
    ).join(F.broadcast(masks), "one")
    open_ = F.exists("masks", lambda m: m.bitwiseAND(F.col("mask")) == 0)
    return joined.select(
        "profile",
        F.when(F.size("masks") == 0, "UNKNOWN").when(F.col("near_copies") > 1, "AMBIGUOUS")
        .when(F.col("verdict") == "LIKELY_MATCH", "MATCHED").when(F.col("verdict") == "POSSIBLE_MATCH", "AMBIGUOUS")
        .when(open_, "UNKNOWN").otherwise("ABSENT").alias("catalogued"),
    )


def with_ownership(members: DataFrame, status: DataFrame, flags: DataFrame) -> DataFrame:
    """key, catalogued, owned, wanted; owned and wanted stay null where nothing was stated. flags: key, owned, wanted."""
    return members.join(status, "profile").join(flags, "key", "left").select("key", "catalogued", "owned", "wanted")


DECISIONS = ["SUGGESTED", "CONFIRMED", "REJECTED"]


def apply_decisions(log: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Latest decision per key of (key, decision, decided_at, title, provider, url); blank keys are ignored.

    Of decisions at the same instant the later row of the batch (``seq``) wins.
    """
    rows = log if new is None else log.unionByName(new)
    fields = ["decision", "decided_at", "title", "provider", F.nullif(strip(F.col("url")), F.lit("")).alias("url")]
    return (
        rows.filter(strip(F.col("key")) != "").groupBy("key")
        .agg(F.max_by(F.struct(*fields), F.struct("decided_at", "seq")).alias("d")).select("key", "d.*")
    )


def decision_state(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with their decision; without one they are SUGGESTED."""
    return candidates.join(decisions.select("key", "decision"), "key", "left").withColumn(
        "decision", F.coalesce("decision", F.lit("SUGGESTED"))
    )


def decided_keys(decisions: DataFrame, decision: str) -> DataFrame:
    return decisions.filter(F.col("decision") == decision).select("key")


def undecided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates never decided, or set back to SUGGESTED."""
    settled = decisions.filter(F.col("decision") != "SUGGESTED").select("key")
    return candidates.join(settled, "key", "left_anti")
