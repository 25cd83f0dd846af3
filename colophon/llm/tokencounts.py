"""Token counts of whole texts with a whole-token shortcut.

Before any text is read, a Spark job proves for every string of the vocabulary whether its merges, run to their end, give
exactly one token. A pre-token that is such a string counts one without being merged; that holds for most of a text. Only
the rest is merged, through a heap of adjacent pairs over linked symbols.

The vocabulary file is the `tokenizers` format: byte-level BPE with ranked pair merges and no normaliser; anything else is
refused. Two details of that library decide counts and are taken from it rather than assumed: strings of added tokens
inside a text count as one token, and the letter and number classes of the pre-token pattern. Where the library's Unicode
tables and those of the matcher used here differ, a text that has such a character is split by the library itself.

What is broadcast has the size of the vocabulary. Texts are counted where they lie, whole; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from colophon.llm.bpe import splitter

CACHE_ENTRIES, CACHED_CHARS = 1 << 18, 64  # merged pre-tokens a task remembers, and the longest that it does
LAST_LETTER_PLANE = 0x40000
SLICE_CHARS = 1 << 20  # pre-tokens of a longer text are counted as they are found, not listed first


def byte_alphabet() -> str:
    """The character that stands for each byte in vocabulary files: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return "".join(shown[b] for b in range(256))


@dataclass
class Vocabulary:
    """Pairs of symbols in merge order, symbols as raw bytes; strings of added tokens."""

    tokens: list[bytes]
    merges: dict[tuple[bytes, bytes], int]
    added: list[str]
    suspects: list[tuple[int, int]] = field(default_factory=list)  # characters of other classes in the library
    proven: frozenset = field(default_factory=frozenset)  # pre-tokens (text) that are one token


def read_vocabulary(path: str) -> Vocabulary:
    """The file's tokens, merges and added tokens; a ``ValueError`` for a model that this operator does not count."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or odd or spec.get("normalizer") or before.get("type") != "ByteLevel":
        raise ValueError(f"not plain byte-level BPE: {odd or before.get('type')}")
    if before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("a prefix space or a missing pre-token pattern is not supported")
    added = spec.get("added_tokens") or []
    if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take blanks or whole words are not supported")
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    raw = lambda shown: bytes(byte_of[c] for c in shown)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
    names = {a["content"] for a in added}
    return Vocabulary([raw(t) for t in model["vocab"] if t not in names], merges, sorted(names, key=lambda s: (-len(s), s)))


def merged_parts(piece: bytes, merges: dict[tuple[bytes, bytes], int]) -> int:
    """Number of tokens left when the pair of lowest rank (leftmost among equals) is merged until none is known."""
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (rank := merges.get((a, b))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if symbol[i] is not None else -1
        if j < 0 or symbol[i] != a or symbol[j] != b:
            continue  # one of the two has been merged since
        symbol[i], symbol[j], after[i] = a + b, None, after[j]
        left -= 1
        if after[i] >= 0:
            before[after[i]] = i
            if (rank := merges.get((symbol[i], symbol[after[i]]))) is not None:
                heapq.heappush(heap, (rank, i, symbol[i], symbol[after[i]]))
        if before[i] >= 0 and (rank := merges.get((symbol[before[i]], symbol[i]))) is not None:
            heapq.heappush(heap, (rank, before[i], symbol[before[i]], symbol[i]))
    return left


def prove(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """token (binary), alone: whether the token's own bytes merge back into one token. One row per vocabulary string."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("struct<token: binary, alone: boolean>")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for ids in batches:
            tokens = [known.tokens[i] for i in ids]
            yield pd.DataFrame({"token": tokens, "alone": [merged_parts(t, known.merges) == 1 for t in tokens]})

    return spark.range(len(vocabulary.tokens)).select(check("id").alias("_c")).select("_c.*")


def unlike_characters(path: str, pattern: str) -> list[tuple[int, int]]:
    """Ranges (first, last) of the characters that the file's library and the matcher used here split differently.

    Each character is tried behind a letter, before a number and behind a symbol, so every class shows. Planes 4 to 16 hold
    no letter, number or blank in any version of Unicode.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    ours = regex.compile(pattern).finditer
    found: list[tuple[int, int]] = []
    for low in range(0x80, LAST_LETTER_PLANE, 4096):
        chars = [chr(c) for c in range(low, min(low + 4096, LAST_LETTER_PLANE)) if not 0xD800 <= c < 0xE000]
        probe = "".join(f"\na{c}1!{c}" for c in chars)
        theirs, own = [b for _, (_, b) in split(probe)], [m.end() for m in ours(probe)]
        if theirs == own:
            continue
        for k in sorted({(end - 1) // 6 for end in set(theirs) ^ set(own)}):  # six characters a probe
            c = ord(chars[k])
            if found and found[-1][1] == c - 1:
                found[-1] = (found[-1][0], c)
            else:
                found.append((c, c))
    return found


class Counts(dict):
    """Pre-token -> number of its tokens: one for proven strings, merged when first met for others."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.proven, 1))
        self.vocabulary, self.entries = vocabulary, len(vocabulary.proven) + CACHE_ENTRIES

    def __missing__(self, piece: str) -> int:
        n = merged_parts(piece.encode("utf-8", "surrogatepass"), self.vocabulary.merges)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= self.entries:
                self.clear()
                self.update(dict.fromkeys(self.vocabulary.proven, 1))
            self[piece] = n
        return n


class TextCounter:
    """Text -> number of tokens, inside a task."""

    def __init__(self, path_text: str, pattern: str, vocabulary: Vocabulary):
        self.counts = Counts(vocabulary)
        self.split, self.find = splitter(pattern), regex.compile(pattern).finditer
        self.added = regex.compile("|".join(map(regex.escape, vocabulary.added))) if vocabulary.added else None
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in vocabulary.suspects)
        self.suspect = re.compile(f"[{ranges}]") if ranges else None
        self.spec, self._library = path_text, None

    def _stretch(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        number = self.counts.__getitem__
        if self.suspect is not None and not text.isascii() and self.suspect.search(text):
            return sum(number(text[a:b]) for _, (a, b) in self._library_split(text))
        if len(text) > SLICE_CHARS:
            return sum(number(m.group()) for m in self.find(text))
        return sum(map(number, self.split(text)))

    def _library_split(self, text: str):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.spec).pre_tokenizer.pre_tokenize_str
        return self._library(text)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or self.added.search(text) is None:
            return self._stretch(text)
        stretches = self.added.split(text)
        return len(stretches) - 1 + sum(map(self._stretch, stretches))


_KEPT: dict[str, TextCounter] = {}  # of the Python worker, so that its next task starts warm


class TokenCounter:
    """A vocabulary file with its proven strings, ready to count columns of texts."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        vocabulary = read_vocabulary(path)
        alone = prove(spark, vocabulary).filter("alone").toPandas()["token"]  # at most one row per vocabulary string
        text_of = (_text(bytes(t)) for t in alone)
        vocabulary.proven = frozenset(t for t in text_of if t is not None)
        vocabulary.suspects = unlike_characters(path, pattern)
        # only the pre-tokenizer is needed in tasks: the same file without its vocabulary
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        spec["model"]["vocab"], spec["model"]["merges"], spec["added_tokens"] = {}, [], []
        self.vocabulary, self._key = vocabulary, uuid.uuid4().hex
        self._shared = spark.sparkContext.broadcast((json.dumps(spec), pattern, vocabulary))

    def count(self, text: Column) -> Column:
        """Number of tokens of the whole text; null is read as empty and has none."""
        shared, key = self._shared, self._key

        @F.pandas_udf(T.LongType())
        def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if key not in _KEPT:
                _KEPT.clear()
                _KEPT[key] = TextCounter(*shared.value)
            number = _KEPT[key]
            for texts in batches:
                yield pd.Series([number(t) for t in texts], dtype="int64")

        return tokens(text)


def _text(token: bytes) -> str | None:
    """The token as text; None for bytes that are no whole characters, which no pre-token is."""
    try:
        return token.decode()
    except UnicodeDecodeError:
        return None


def token_counts(docs: DataFrame, counter: TokenCounter, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``.

    Null and empty texts have no byte and no token; repeated rows and null ids stay as they are; an empty table gives an
    empty result; other columns are not read, so their names cannot clash.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    counted = docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_bytes"), counter.count(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
