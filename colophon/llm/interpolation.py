"""N-gram scoring by deleted interpolation.

log10 P(text) = sum over its tokens w after v of log10(l2 * c(v,w)/c(v) + l1 * c(w)/N + l0 / (V+1)); the weights (l2, l1, l0)
depend on how often the context v was seen (buckets of doubling counts) and are learned by expectation-maximisation on
*held-out counts*: one fold of the training texts is deleted from the counts, and its tokens are predicted from the rest.
The final scores use the counts of all training texts.

Counts cover all training texts and grow with them; nothing of them passes the driver. Words and pairs are 64-bit hashes
(two of 10^8 different ones share a hash with a chance of about 1 in 4,000). The flow, with what is shuffled packed into arrays:

1. ``packed``: texts are split where they lie into chunks of at most ``chunk_tokens`` tokens (a longer text is its own chunk);
   a chunk is one row with its own word list and token numbers, written once. No shuffle.
2. Each chunk sends, per partition of the hash space, its different words and pairs with their counts (pre-aggregated: a word of
   a third of all tokens is one entry per chunk).
3. A partition adds up the counts and answers every chunk in the order it asked.
4. Chunks of the held-out fold meet their answers and become a table of token counts by (bucket, p2, p1) in twentieths of a
   decade, on which EM runs; then all chunks meet their answers and score their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from colophon.llm.shared import written

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"  # no word has a blank in it
PAIR = np.uint64(0x9E3779B97F4A7C15)
BUCKETS, STEP = 24, 20
SCORE_ONLY, FIT, DELETED = 0, 1, 2  # roles of a text: counted nowhere, counted, counted and predicted for the weights


def _planes(a: np.ndarray) -> bytes:
    """The bytes of an array by significance, not by value: the high bytes of sorted hashes and small counts compress away."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _plain(data: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    n = len(data) // kind.itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=len(data)).reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.empty(0, kind)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        x = (a * PAIR) ^ (b + (a >> np.uint64(32)))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def packed(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Chunks of (chunk, deleted, ids, null_ids, counted, lengths, vocab, tokens) from rows of (doc_id, role, text).

    Per text there is an id, a flag for a null one, a flag for a text that counts, and a length; ``tokens`` numbers every word
    and end in order, ``vocab`` has the hashes by number. Deleted texts have chunks of their own. Arrays are :func:`_planes`.
    """

    def chunk(deleted: bool, ids: list, counted: list[bool], lengths: list[int], words: dict[bytes, int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
        row = {
            "chunk": uuid.uuid4().hex, "deleted": deleted, "ids": _planes(np.array([0 if i is None else i for i in ids], dtype=np.int64)),
            "null_ids": _planes(np.array([i is None for i in ids], dtype=np.uint8)), "counted": _planes(np.array(counted, dtype=np.uint8)),
            "lengths": _planes(np.array(lengths, dtype=np.int64)), "vocab": _planes(hashes), "tokens": _planes(np.concatenate(tokens)),
        }
        return pa.RecordBatch.from_pylist([row], schema=CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[bool, tuple] = {}
        for batch in batches:
            for doc_id, role, text in zip(batch.column("doc_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text"), strict=True):
                split = (text.as_py() or "").encode().translate(_LOWER).split()
                deleted = role == DELETED
                if deleted in open_ and open_[deleted][0] + len(split) > chunk_tokens:
                    yield chunk(deleted, *open_.pop(deleted)[1:])
                size, ids, counted, lengths, words, tokens = open_.pop(deleted, (0, [], [], [], {END: 0}, []))
                number = words.setdefault
                tokens.append(np.array([*[number(w, len(words)) for w in split], 0], dtype=np.int32))
                ids.append(doc_id)
                counted.append(role != SCORE_ONLY)
                lengths.append(len(split) + 1)
                open_[deleted] = (size + len(split) + 1, ids, counted, lengths, words, tokens)
        for deleted, rest in open_.items():
            yield chunk(deleted, *rest[1:])

    return docs.select("doc_id", "role", "text").mapInArrow(run, CHUNK_DDL)


_ARRAYS = ("ids", "null_ids", "counted", "lengths", "vocab", "tokens")
CHUNK_DDL = "chunk string, deleted boolean, " + ", ".join(f"{c} binary" for c in _ARRAYS)
CHUNK = pa.schema([("chunk", pa.string()), ("deleted", pa.bool_()), *((c, pa.binary()) for c in _ARRAYS)])


def _codes(vocab: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the chunk's tokens, those of their contexts, and the pair hashes; a text starts after an end."""
    hashes = _plain(vocab, np.uint64)
    words = hashes[_plain(tokens, np.int32)]
    contexts = np.concatenate((hashes[:1], words[:-1]))
    return words, contexts, _mix(contexts, words)


def _cuts(sorted_codes: np.ndarray, parts: int) -> np.ndarray:
    """Borders of the partitions of the hash space in sorted codes."""
    width = (1 << 64) // parts + 1
    borders = np.array([i * width for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_codes, borders), [len(sorted_codes)]))


def requests(chunks: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, deleted, words, word_counts, pairs, pair_counts): what a chunk has in each partition of the hash space.

    Codes are sorted; counts are those in texts that count, 0 for a code of other texts only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["chunk", "deleted", "counted", "lengths", "vocab", "tokens"]).to_pylist():
                words, _, pairs = _codes(row["vocab"], row["tokens"])
                weight = np.repeat(_plain(row["counted"], np.uint8), _plain(row["lengths"], np.int64))
                columns: dict[str, list] = {"part": list(range(parts)), "chunk": [row["chunk"]] * parts, "deleted": [row["deleted"]] * parts}
                for name, codes in (("word", words), ("pair", pairs)):
                    unique, at = np.unique(codes, return_inverse=True)
                    counts = np.bincount(at, weights=weight, minlength=len(unique)).astype(np.uint32)
                    cuts = _cuts(unique, parts)
                    columns[f"{name}s"] = [_planes(unique[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    columns[f"{name}_counts"] = [_planes(counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_pydict(columns, schema=REQUEST)

    return chunks.mapInArrow(run, "part int, chunk string, deleted boolean, words binary, word_counts binary, pairs binary, pair_counts binary")


REQUEST = pa.schema([("part", pa.int32()), ("chunk", pa.string()), ("deleted", pa.bool_()), *((c, pa.binary()) for c in ("words", "word_counts", "pairs", "pair_counts"))])


def _added(codes: list[np.ndarray], counts: list[np.ndarray], deleted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different codes of all requests with their sums, over all and over those that aren't deleted."""
    unique = np.unique(np.concatenate(codes))
    both, fit = np.zeros(len(unique), dtype=np.uint64), np.zeros(len(unique), dtype=np.uint64)
    for c, n, out in zip(codes, counts, deleted, strict=True):  # the codes of one chunk are different
        at = np.searchsorted(unique, c)
        both[at] += n
        if not out:
            fit[at] += n
    return unique, both, fit


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, deleted, part, words, words_fit, pairs, pairs_fit, tokens, types, tokens_fit), one row per request.

    Counts are unsigned 64-bit, in the order of the request: of all texts that count, and (for deleted chunks only) of those
    that aren't deleted. (A chunk's own counts are below 2^32, sums over the corpus may not be.) The last three are sums of the partition, given once. A partition holds its share of the hash space,
    and the number of partitions grows with the tokens.
    """
    ddl = "chunk string, deleted boolean, part int, words binary, words_fit binary, pairs binary, pairs_fit binary, tokens long, types long, tokens_fit long"

    def add(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("chunk")
        out = {"chunk": rows.chunk, "deleted": rows.deleted, "part": rows.part}
        sums = {}
        for name in ("word", "pair"):
            codes = [_plain(x, np.uint64) for x in rows[f"{name}s"]]
            counts = [_plain(x, np.uint32) for x in rows[f"{name}_counts"]]
            unique, both, fit = _added(codes, counts, rows.deleted)
            found = [np.searchsorted(unique, c) for c in codes]
            out[f"{name}s"] = [_planes(both[at]) for at in found]
            out[f"{name}s_fit"] = [_planes(fit[at]) if d else b"" for at, d in zip(found, rows.deleted, strict=True)]
            if name == "word":
                sums = {"tokens": both.sum(), "types": (both > 0).sum(), "tokens_fit": fit.sum()}
        for name, value in sums.items():
            out[name] = [int(value), *[0] * (len(rows) - 1)]
        return pd.DataFrame(out)

    return asked.groupBy("part").applyInPandas(add, ddl)


def _seen(chunk: pd.Series, replies: pd.DataFrame, fit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of word, context and pair for every token of a chunk, put together from its answers."""
    words, contexts, pairs = _codes(chunk.vocab, chunk.tokens)
    by_part = replies.sort_values("part")
    suffix = "_fit" if fit else ""
    w = np.unique(words)
    p, at = np.unique(pairs, return_inverse=True)
    wc, pc = (np.concatenate([_plain(x, np.uint64) for x in by_part[f"{c}{suffix}"]]).astype(np.int64) for c in ("words", "pairs"))
    return wc[np.searchsorted(w, words)], wc[np.searchsorted(w, contexts)], pc[at]


def bucket(context_count: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context_count + 1)).astype(np.int64), BUCKETS - 1)


def _meet(chunks: DataFrame, replies: DataFrame, ddl: str, work) -> DataFrame:
    columns = ["chunk", "ids", "null_ids", "lengths", "vocab", "tokens"]
    answered = replies.select("chunk", "part", "words", "words_fit", "pairs", "pairs_fit")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left.iloc[0], right)

    return chunks.select(*columns).groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(run, ddl)


def learn(deleted: DataFrame, replies: DataFrame, tokens_fit: int, rounds: int = 40) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and uniform estimates by EM over the held-out tokens."""

    def events(chunk: pd.Series, right: pd.DataFrame) -> pd.DataFrame:
        c1, cv, c2 = _seen(chunk, right, True)
        log = lambda x: np.where(x > 0, np.round(STEP * np.log10(np.maximum(x, 1e-30))), -9999).astype(np.int64)
        cells = pd.DataFrame({"b": bucket(cv), "p2": log(c2 / np.maximum(cv, 1)), "p1": log(c1 / max(1, tokens_fit))})
        return cells.groupby(["b", "p2", "p1"], as_index=False).size().rename(columns={"size": "n"})

    cells = _meet(deleted, replies, "b long, p2 long, p1 long, n long", events).groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")).toPandas()
    weights = np.tile(np.array([0.5, 0.4, 0.1]), (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    if cells.empty:
        return weights
    value = lambda c: np.where(cells[c] <= -9999, 0.0, 10.0 ** (cells[c].to_numpy(float) / STEP))
    uniform = np.full(len(cells), 1.0 / (1 + max(1, tokens_fit)))
    p, b, n = np.stack([value("p2"), value("p1"), uniform], axis=1), cells.b.to_numpy(), cells.n.to_numpy(float)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        total = np.stack([np.bincount(b, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1)
        seen = total.sum(axis=1) > 0
        weights[seen] = (total[seen] + 1e-3) / (total[seen] + 1e-3).sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, role: Column, chunk_tokens: int = 2_000_000, part_tokens: int = 2_000_000) -> DataFrame:
    """(doc_id, role, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text and more).

    ``role`` says what a text teaches: SCORE_ONLY, FIT or DELETED (in the counts, but left out of those that its own tokens are
    predicted from when the weights are learned). A null text is empty: one token, its end. Repeated rows and null ids stay.
    Without any training text every count is 0 and all probability is uniform.
    """
    chunks = written(packed(docs.select("doc_id", role.alias("role"), "text"), chunk_tokens), "chunks")
    size = chunks.agg(F.coalesce(F.sum(F.length("tokens") / 4), F.lit(0.0)).alias("n")).first().n
    parts = max(8, int(-(-size // part_tokens)))
    replies = written(answers(requests(chunks, parts).repartition(parts, "part")), "answers")
    sums = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "tokens_fit")]).first()
    weights = learn(chunks.filter("deleted"), replies.filter("deleted"), sums.tokens_fit)
    n, v = int(sums.tokens), int(sums.types)

    def scores(chunk: pd.Series, right: pd.DataFrame) -> pd.DataFrame:
        c1, cv, c2 = _seen(chunk, right, False)
        w = weights[bucket(cv)]
        p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * c1 / max(1, n) + w[:, 2] / (v + 1)
        lengths = _plain(chunk.lengths, np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        ids, none = _plain(chunk.ids, np.int64), _plain(chunk.null_ids, np.uint8).astype(bool)
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(ids, none), "n_tokens": lengths, "n_known": np.add.reduceat((c1 > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(np.log10((c1 + 1.0) / (n + 1.0 * (v + 1))), starts), "score": np.add.reduceat(np.log10(np.maximum(p, 1e-300)), starts),
        })

    out = _meet(chunks, replies, "doc_id long, n_tokens long, n_known long, base_score double, score double", scores)
    return out.withColumn("train_tokens", F.lit(n).cast("long"))
