"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a vocabulary entry costs one probe
and one comparison. Tier two merges the bytes of every other pre-token: the bytes form a linked list, and a heap yields
the adjacent pair of lowest rank (the leftmost among equal ones) until no pair is in the vocabulary. A merge touches two
neighbours only, so a pre-token of n bytes takes O(n log n) however long it is.

The vocabulary is read on the driver (``path`` is a parameter) and sent to the executors; its size is that of the rank file,
not of the data. Rows are encoded where they lie: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MASK = (1 << 64) - 1
CACHE_ENTRIES = 1 << 18  # pre-tokens whose ids a task remembers; the memory is emptied when full
CACHED_CHARS = 256  # longer pre-tokens are merged anew each time, so that what is remembered is bounded in bytes
PART_CHARS = 1 << 19  # characters whose ids a task holds at once, or one text


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of ``base64 rank`` lines; ranks must run from 0 without a hole."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be consecutive from 0")
    return [found[i] for i in range(len(found))]


class PerfectHash:
    """Minimal perfect hash by hashing and displacing: as many slots as keys, one displacement per bucket of keys.

    Keys of a bucket are moved together until they fall into free slots; a bucket of one key names its slot directly.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 2)
        self.shift = array("q", bytes(8 * self.buckets))
        self.order = array("q", bytes(8 * self.size))  # slot -> index of the key
        self.keys = keys
        members: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            members.setdefault(h % self.buckets, []).append((h, i))
        taken = bytearray(self.size)
        single = []
        for bucket, group in sorted(members.items(), key=lambda item: (-len(item[1]), item[0])):
            if len(group) == 1:
                single.append((bucket, group[0][1]))
                continue
            d = 0
            while True:
                slots = {self._slot(h, d) for h, _ in group}
                if len(slots) == len(group) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for h, i in group:
                s = self._slot(h, d)
                taken[s], self.order[s] = 1, i
        free = (s for s in range(self.size) if not taken[s])
        for bucket, i in single:
            s = next(free)
            self.shift[bucket], self.order[s] = -1 - s, i

    def _slot(self, h: int, d: int) -> int:
        mixed = ((h ^ (d * 0x9E3779B97F4A7C15 & MASK)) * 0xFF51AFD7ED558CCD) & MASK
        return (mixed >> 29) % self.size

    def find(self, key: bytes) -> int:
        """Index of the key, or -1."""
        if not self.size:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = self.order[-1 - d if d < 0 else self._slot(h, d)]
        return i if self.keys[i] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging its linked bytes, lowest rank first and leftmost among equals."""
    n, rank_of, pop, push = len(piece), ranks.get, heapq.heappop, heapq.heappush
    end = [*range(1, n + 1), -1]  # of the part that starts here; -1 behind the last byte and where none starts any more
    before = [*range(-1, n)]
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, stop = pop(heap)
        right = end[left]
        if right < 0 or end[right] != stop:
            continue  # one of the two parts has grown or gone since
        end[right], end[left], before[stop] = -1, stop, left
        if stop < n and (rank := rank_of(piece[left : end[stop]])) is not None:
            push(heap, (rank, left, end[stop]))
        if (previous := before[left]) >= 0 and (rank := rank_of(piece[previous:stop])) is not None:
            push(heap, (rank, previous, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def splitter(pattern: str):
    """text -> pre-tokens. Texts of ASCII only go through the standard matcher with the classes spelled out: it is faster."""
    full = regex.compile(pattern).findall
    inner = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r\x20"}  # fixed values: the classes within ASCII
    plain = pattern.replace(r"\S", r"[^\t-\r\x20]")
    parts = re.split(r"(\[[^\]]*\])", plain)
    for k, part in enumerate(parts):
        for name, members in inner.items():
            part = part.replace(name, members if k % 2 else f"[{members}]")
        parts[k] = part
    ascii_only = re.compile("".join(parts)).findall
    return lambda text: ascii_only(text) if text.isascii() else full(text)


class Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; fills itself."""

    def __init__(self, found: PerfectHash, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.found, self.entries = found, entries
        self.ranks = {token: i for i, token in enumerate(found.keys)}

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.found.find(data)
        ids = (whole,) if whole >= 0 else merge_bytes(data, self.ranks)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) > CACHED_CHARS:
            return packed
        if len(self) >= self.entries:
            self.clear()
        self[piece] = packed
        return packed


_KEPT: dict[str, Pieces] = {}  # of the Python worker, so that its next task starts warm


def _pieces(key: str, found: PerfectHash) -> Pieces:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Pieces(found)
    return _KEPT[key]


def parts(texts: Iterable[str | None], chars: int = PART_CHARS) -> Iterator[list[str]]:
    """The texts in runs of about ``chars`` characters; null is read as empty. A batch is as many rows as the session says,
    however long they are, and its ids take more room than its texts."""
    run, held = [], 0
    for text in texts:
        run.append(text or "")
        held += len(run[-1])
        if held >= chars:
            yield run
            run, held = [], 0
    if run:
        yield run


class Tokenizer:
    """A vocabulary and a pre-token pattern that can be sent to executors."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens = read_ranks(path)
        self._found = spark.sparkContext.broadcast(PerfectHash(tokens))
        self._pattern, self._key = pattern, uuid.uuid4().hex

    def encode(self, text: Column) -> Column:
        """array<int> of ids of the whole text; null is read as empty."""
        shared, pattern, key = self._found, self._pattern, self._key

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            split, pieces = splitter(pattern), _pieces(key, shared.value)
            for texts in batches:
                for run in parts(texts):
                    packed = (b"".join(map(pieces.__getitem__, split(t))) for t in run)
                    yield pd.Series([np.frombuffer(x, dtype="<i4") for x in packed], dtype=object)

        return ids(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes that an array of ids stands for; null gives null, an unknown id is an error."""
        shared = self._found

        @F.pandas_udf(T.BinaryType())
        def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            token = shared.value.keys.__getitem__
            for rows in batches:
                yield pd.Series([None if r is None else b"".join(map(token, r.tolist())) for r in rows], dtype=object)

        return data(ids)

    def digest(self, ids: Column, with_ids: bool = False) -> Column:
        """struct<n_tokens, ids_sha256, decoded_sha256> of encoded ids, and the ids themselves if asked for."""
        shared = self._found
        names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 if with_ids else 3]
        schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

        @F.pandas_udf(schema)
        def summary(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            token = shared.value.keys.__getitem__
            for rows in batches:
                out = []
                for r in rows:
                    packed = np.asarray([] if r is None else r, dtype="<u4")
                    decoded = hashlib.sha256(b"".join(map(token, array("i", packed.tobytes()))))
                    out.append((len(packed), hashlib.sha256(packed.tobytes()).hexdigest(), decoded.hexdigest(), packed.view("<i4"))[: len(names)])
                yield pd.DataFrame(out, columns=names)

        return summary(ids)


def token_digests(docs: DataFrame, tokenizer: Tokenizer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and digests of the ids and of the decoded bytes.

    Null and empty texts have no token; repeated rows and null ids stay as they are; other columns are not read.
    """
    summary = tokenizer.digest(tokenizer.encode(F.col(text)))
    return docs.select(F.col(doc_id).alias("doc_id"), summary.alias("_s")).select("doc_id", "_s.*")
