"""Exact token counts of prefixes, by dynamic programming.

Between chunks (runs of text between white space) counts add up: count(prefix + chunk) =
count(prefix) + count(chunk), as no token of this kind of tokenizer spans white space. Chunk
counts come from the library itself and stay in a bounded cache. Within a chunk, words (the
tokenizer's pieces) add up, and within a word the pair encoding of every prefix follows from
those of shorter ones: its last token is the one that may stand behind the last token of the
prefix before it, so count(prefix) = count(shorter prefix) + 1. Budget and truncation
questions are answered from these sums at every character, without encoding again.

A tokenizer whose counts do not add up over white space is refused with an error.

Defined results: a null text counts as an empty one (0 tokens, 0 bytes); repeated rows are
counted each; long texts take one pass; other columns are carried, and the output's names
win over columns of the same name. A special string, and a chunk that holds characters whose normal form differs in
length, only offers the prefixes up to it, and its own end.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import kernel
from .store import bound_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker for each core
#: Chunks kept in a worker's cache, and the longest that is kept.
CACHE_CHUNKS, CACHE_BYTES = 200_000, 64
#: Special strings hold no white space, so each lies in one chunk. One tokenizer and cache per worker and vocabulary.
_tokenizers: dict[bytes, "ChunkCounts"] = {}


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable and no space, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


_SYMBOLS = _byte_symbols()
_PROBES = ("the", "The", "a.b", "don't", "12", "日本", "naïve", "e\u0301", "x" * 40, "!?")
_SPACES = (" ", "  ", "\n", "\t ", "\r\n", " \n\n ")


def check_additive(tokenizer: Tokenizer) -> None:
    """Raise an error if counts do not add up over white space."""
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for a, b, w in zip(_PROBES * 6, (_PROBES[3:] + _PROBES[:3]) * 6, sorted(_SPACES * 10)):
        if n(w + a + w + b + w) != n(a) + n(b):
            raise ValueError(f"the token counts of this tokenizer do not add up over white space: {a!r}, {w!r}, {b!r}")


class WordPrefixes:
    """Token counts of every prefix of a word, for byte-level pair encodings with word ends."""

    def __init__(self, model: dict):
        self.end = model["end_of_word_suffix"]
        self.vocabulary = model["vocab"]
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        self.known: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        whole = token.removesuffix(self.end)
        return [*whole[:-1], whole[-1] + token[len(whole) :]]

    def follows(self, a: str, b: str) -> bool:
        """Whether the tokens a and b (or b alone) are what their own text is encoded as."""
        if (a, b) not in self.known:
            parts = [*(self._symbols(a) if a else []), *self._symbols(b)]
            while len(parts) > 1:
                rank, at = min((self.ranks.get((x, y), 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[a, b] = parts == ([a, b] if a else [b])
        return self.known[a, b]

    def _last(self, symbols: str, j: int, last: list[str], suffix: str) -> tuple[int, str]:
        """The start and the token that ends the encoding of the first j symbols."""
        for start in range(max(0, j - self.longest), j):
            token = symbols[start:j] + suffix
            if token in self.vocabulary and self.follows(last[start], token):
                return start, token
        raise ValueError("a word that the vocabulary can't encode")

    def counts(self, word: list[bytes], most: int) -> list[int]:
        """The count of the first 1, 2, ... characters as a word; ends where an open prefix has over `most` tokens."""
        symbols = "".join(_SYMBOLS[b] for c in word for b in c)
        many, last, out, j = [0], [""], [], 0
        for c in word:
            start, _ = self._last(symbols, j + len(c), self._to(symbols, j + len(c) - 1, many, last), self.end)
            out.append(many[start] + 1)
            j += len(c)
            if many[-1] > most:
                break
        return out

    def _to(self, symbols: str, n: int, many: list[int], last: list[str]) -> list[str]:
        """The last tokens of the open prefixes of up to n symbols."""
        while len(many) <= n:
            start, token = self._last(symbols, len(many), last, "")
            many.append(many[start] + 1)
            last.append(token)
        return last


#: What ends a word by a letter's form: the tokenizer's contractions.
_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


class ChunkCounts(dict):
    """chunk -> its token count, by the library."""

    def __init__(self, data: bytes):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        check_additive(self.tokenizer)
        whole = json.loads(data)
        self.special = {t["content"] for t in whole.get("added_tokens", [])}
        self.words = WordPrefixes(whole["model"]) if whole["model"].get("end_of_word_suffix") else None

    def inside(self, chunk: bytes, most: int) -> tuple[list[int], list[int]]:
        """Byte ends of prefixes of a chunk and their counts, up to where a word has over `most` tokens; the chunk's own end need not be among them."""
        text = chunk.decode("utf-8")
        stop = min((i for i in (text.find(x) for x in self.special) if i >= 0), default=len(text))
        text = text[:stop]
        lowered = [c.lower() for c in text]
        if self.words is None or unicodedata.normalize("NFC", text) != text or any(len(c) != 1 for c in lowered):
            return [], []
        plain = "".join(lowered)
        ends, counts, at, before, byte = [], [], 0, 0, 0
        for piece, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
            if a != at:
                break
            word = [c.encode("utf-8") for c in plain[a:b]]
            own = self.words.counts(word, most - before)
            if _CONTRACTION.fullmatch(plain[a:b]) and len(word) == 3:
                own[1] = own[0] + self.words.counts(word[1:2], most)[0]  # its first letter would be a word of its own
            for c, n in zip(text[a:b], own):
                byte += len(c.encode("utf-8"))
                ends.append(byte)
                counts.append(before + n)
            if len(own) < len(word) or before + own[-1] > most:
                break
            before, at = before + own[-1], b
        return ends, counts

    def of(self, chunks: list[bytes]) -> np.ndarray:
        missing = list({c for c in chunks if c not in self})
        extra: dict[bytes, int] = {}
        if missing:
            if len(self) + len(missing) > CACHE_CHUNKS:
                self.clear()
                missing = list(set(chunks))
            for i in range(0, len(missing), 10_000):
                part = missing[i : i + 10_000]
                found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in part], add_special_tokens=False)
                for c, e in zip(part, found, strict=True):
                    (self if len(c) <= CACHE_BYTES else extra)[c] = len(e.ids)
        if extra:
            return np.array([self[c] if c in self else extra[c] for c in chunks], np.int64)
        return np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))


def _counts(data: bytes) -> ChunkCounts:
    if data not in _tokenizers:
        _tokenizers[data] = ChunkCounts(data)
    return _tokenizers[data]


def prefix_table(buf: np.ndarray, bounds: np.ndarray, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: the bytes at which each chunk starts and ends, and the token count of the prefix that ends there."""
    starts, ends, firsts = kernel.word_spans(buf, bounds, kernel.separators("space"))
    text = buf.tobytes()
    edges = bounds.tolist()
    chunks: list[bytes] = []
    for a, b in zip(edges, edges[1:]):
        chunks += text[a:b].split()
    total = np.concatenate([[0], np.cumsum(_counts(data).of(chunks))])
    for i, (a, b) in enumerate(zip(firsts.tolist(), firsts[1:].tolist())):
        yield starts[a:b] - bounds[i], ends[a:b] - bounds[i], total[a + 1 : b + 1] - total[a]


def longest_prefix(text: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, limit: int, data: bytes) -> tuple[int, int]:
    """The byte at which the longest prefix of at most `limit` tokens ends, at any character, and its tokens."""
    k = int(np.searchsorted(counts, limit, "right"))
    best = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
    if k < len(counts):
        at, before = int(starts[k]), best[1]
        for end, n in zip(*_counts(data).inside(text[at : int(ends[k])], limit - before)):
            if before + n <= limit:
                best = (at + end, before + n)
    return best


def _mapped(df: DataFrame, path: str, text: str, made: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    bound_batches(df.sparkSession)
    carry = [c for c in df.columns if c not in made and c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry), *(f"`{k}` {v[0]}" for k, v in made.items())])
    with open(path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of under a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, buf, bounds in kernel.chunks(batch.column(batch.schema.get_field_index(text))):
                edges = bounds.tolist()
                rows += [row(buf[a:b], *table, vocabulary.value) for a, b, table in zip(edges[:-1], edges[1:], prefix_table(buf, bounds, vocabulary.value), strict=True)]
            new = [pa.array([r[i] for r in rows], type=kind) for i, (_, kind) in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carry), *new], names=[*carry, *made])

    return df.select(*carry, F.col(text)).mapInArrow(kernel.freeing(run), schema)


def prefix_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replace the text by the prefix table: prefix_bytes and prefix_tokens (array<bigint>), where each prefix ends and its tokens, at every character outside white space
    (in what a special string or a normal form of another length hides, at the chunk's end)."""

    def row(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, data: bytes) -> tuple:
        whole, counter = buf.tobytes(), _counts(data)
        at, many = [], []
        before = 0
        for a, b, n in zip(starts.tolist(), ends.tolist(), counts.tolist()):
            inner, own = counter.inside(whole[a:b], 1 << 60)
            for end, k in zip(inner, own):
                if end < b - a:
                    at.append(a + end)
                    many.append(before + k)
            at.append(b)
            many.append(n)
            before = n
        return at, many

    return _mapped(df, path, text, {"prefix_bytes": ("array<bigint>", pa.list_(pa.int64())), "prefix_tokens": ("array<bigint>", pa.list_(pa.int64()))}, row)


def fits(prefixes: DataFrame, budget: int) -> DataFrame:
    """Add cut_bytes and cut_tokens, the longest stored prefix of at most budget tokens, from prefix_counts' table alone."""
    last = F.array_max(F.transform("prefix_tokens", lambda x, i: F.when(x <= budget, i)))
    return prefixes.select(
        *(c for c in prefixes.columns if c not in ("cut_bytes", "cut_tokens")),
        F.coalesce(F.get("prefix_bytes", last), F.lit(0)).alias("cut_bytes"),
        F.coalesce(F.get("prefix_tokens", last), F.lit(0)).alias("cut_tokens"),
    )


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """Replace the text by n_bytes, n_tokens, over_limit (more than limit tokens) and cut_bytes, the longest prefix within the limit, all read from prefix sums."""

    def row(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, data: bytes) -> tuple:
        n = int(counts[-1]) if len(counts) else 0
        cut = longest_prefix(buf.tobytes(), starts, ends, counts, limit, data)[0] if n > limit else (int(ends[-1]) if len(ends) else 0)
        return len(buf), n, n > limit, cut

    return _mapped(df, path, text, {"n_bytes": ("bigint", pa.int64()), "n_tokens": ("bigint", pa.int64()), "over_limit": ("boolean", pa.bool_()), "cut_bytes": ("bigint", pa.int64())}, row)
