"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every code point has a class; a class is a
transition function on the states of a small automaton. Functions compose, and
composition is associative, so a blocked scan over the functions gives the state before
every code point at once, and with it the token boundaries. The slices between
boundaries feed a bounded cache of merged pairs. Token byte offsets are kept and suffice
to cut the decoded bytes again.

Defined results: a null text encodes as an empty one (no tokens); repeated rows are
encoded each; very long texts and very long pieces take O(n log n); other columns are
carried, and the output's names win over columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import bound_batches

# Character classes. *_LAST: the white space that ends a run before other text.
LETTER, NUMBER, OTHER, SPACE, SPACE_LAST, BLANK_LAST, QUOTE2, QUOTE3, EDGE = range(9)
# States: the kind of token that is open. CLOSED: the next character starts a token.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, JOINED, CLOSED, TAIL1, TAIL2 = range(8)
_STATES, _CLASSES = 8, 9
#: A code point beyond Unicode that stands between texts.
_EDGE_POINT = 0x110000
#: Pieces kept in a worker's cache, and the longest that is kept.
CACHE_PIECES, CACHE_BYTES = 150_000, 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and starts[state, class]."""
    nxt, starts = np.zeros((_STATES, _CLASSES), np.uint8), np.ones((_STATES, _CLASSES), bool)
    nxt[:, [LETTER, NUMBER, OTHER, SPACE, SPACE_LAST, BLANK_LAST, QUOTE2, QUOTE3, EDGE]] = [
        IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, JOINED, CLOSED, TAIL1, TAIL2, CLOSED,
    ]
    for state, kind in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHER, OTHER), (IN_SPACE, SPACE)):
        starts[state, kind] = False
    starts[JOINED, [LETTER, NUMBER, OTHER, QUOTE2, QUOTE3]] = False
    starts[IN_OTHER, [QUOTE2, QUOTE3]] = False
    nxt[np.ix_([JOINED, IN_OTHER], [QUOTE2, QUOTE3])] = IN_OTHER  # the quote is inside a run of signs
    starts[TAIL1, LETTER] = starts[TAIL2, LETTER] = False
    nxt[TAIL1, LETTER], nxt[TAIL2, LETTER] = CLOSED, TAIL1
    return nxt, starts


def _monoid(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that the classes generate: values[f, state], of_class, compose[f, g] (f first)."""
    ids: dict[tuple, int] = {}
    values: list[tuple] = []

    def name(f: tuple) -> int:
        if f not in ids:
            ids[f] = len(values)
            values.append(f)
        return ids[f]

    name(tuple(range(_STATES)))
    of_class = [name(tuple(int(x) for x in nxt[:, c])) for c in range(_CLASSES)]
    done = 0
    while done < len(values):
        f = values[done]
        for c in of_class:
            name(tuple(values[c][s] for s in f))
        done += 1
    n = len(values)
    compose = np.zeros((n, n), np.int16)
    for i, f in enumerate(values):
        for j, g in enumerate(values):
            compose[i, j] = ids[tuple(g[s] for s in f)]
    return np.array(values, np.uint8), np.array(of_class, np.int16), compose


_NEXT, _STARTS = _automaton()
_VALUES, _OF_CLASS, _COMPOSE = _monoid(_NEXT)
_COUNT = np.int32(len(_VALUES))
_FLAT = _COMPOSE.ravel()


# Letters and numbers that Unicode 16.0 added (inclusive ranges). The tokenizer
# library knows them; Python's own database may be older.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)


def class_table() -> np.ndarray:
    """The class of every code point, from the Unicode character database."""
    table = np.full(_EDGE_POINT + 1, OTHER, np.uint8)
    for cp in range(_EDGE_POINT):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            table[a : b + 1] = kind
    for cp in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[cp] = SPACE  # the White_Space property
    table[_EDGE_POINT] = EDGE
    return table


_table: np.ndarray | None = None


def states_before(functions: np.ndarray, start: int = CLOSED) -> np.ndarray:
    """The automaton's state before every position: a blocked associative scan.

    Blocks are columns of a matrix. Rows are composed one after the other for all blocks
    at once, the blocks' totals are scanned, and each block's start state is put through
    its own prefixes."""
    n = len(functions)
    if not n:
        return np.zeros(0, np.uint8)
    rows = max(1, int(np.sqrt(n) / 4))
    blocks = -(-n // rows)
    padded = np.zeros(rows * blocks, np.int16)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(blocks, rows).T)
    prefix = np.zeros_like(grid)  # of what stands before the row, in its block
    now = np.zeros(blocks, np.int16)
    for r in range(rows):
        prefix[r] = now
        now = _FLAT[now.astype(np.int32) * _COUNT + grid[r]]
    state, at = start, np.zeros(blocks, np.uint8)
    for b, f in enumerate(now.tolist()):
        at[b] = state
        state = _VALUES[f, state]
    return _VALUES.ravel()[prefix.astype(np.int32) * _STATES + at].T.ravel()[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Whether each code point (with _EDGE_POINT between texts) starts a token."""
    global _table
    if _table is None:
        _table = class_table()
    kind = _table[points]
    after = np.append(kind[1:], EDGE)
    last = (kind == SPACE) & (after != SPACE) & (after != EDGE)
    kind[last] = np.where(points[last] == 0x20, SPACE_LAST, BLANK_LAST)
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        one = points[np.minimum(quote + 1, len(points) - 1)]
        two = points[np.minimum(quote + 2, len(points) - 1)]
        is2 = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        is3 = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            is3 |= (one == ord(a)) & (two == ord(b))
        kind[quote[is2]] = QUOTE2
        kind[quote[is3]] = QUOTE3
    return _STARTS[states_before(_OF_CLASS[kind]), kind]


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The pieces of each text, in order."""
    if not texts:
        return
    edge = np.array([_EDGE_POINT], np.uint32)
    points = [np.frombuffer(t.decode("utf-8").encode("utf-32-le"), np.uint32) for t in texts]
    joined = np.concatenate([x for p in points for x in (p, edge)])
    starts = boundaries(joined)
    at = 0
    for text, p in zip(texts, points, strict=True):
        own = np.flatnonzero(starts[at : at + len(p)])
        if len(p) != len(text):
            width = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
            own = (np.cumsum(width) - width)[own]
        cuts = own.tolist()
        cuts.append(len(text))
        yield [text[a:b] for a, b in zip(cuts, cuts[1:])] if len(p) else []
        at += len(p) + 1


class Merger(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; merges pairs of the lowest rank first."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        found = np.array(self.merge(piece), "<u4").tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = found
        return found

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 where none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= stop or end[end[i]] != stop:
                continue  # one of the two parts has been merged since
            end[end[i]], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_codecs: dict[bytes, tuple[Merger, list[bytes], np.ndarray]] = {}  # a bytes object keeps its hash


def codec(data: bytes) -> tuple[Merger, list[bytes], np.ndarray]:
    """This process's merger, the bytes of each id and their lengths."""
    if data not in _codecs:
        ranks = load_ranks(data)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        _codecs[data] = (Merger(ranks), pieces, np.array([len(x) for x in pieces], np.int64))
    return _codecs[data]


def encode_texts(texts: list[bytes], data: bytes) -> Iterator[np.ndarray]:
    """The ids of each text."""
    merge = codec(data)[0].__getitem__
    for pieces in slices(texts):
        yield np.frombuffer(b"".join(map(merge, pieces)), "<u4")


def token_offsets(ids: np.ndarray, data: bytes) -> np.ndarray:
    """The byte at which each token starts, and the end."""
    return np.concatenate([[0], np.cumsum(codec(data)[2][ids])])


def decode_ids(ids: np.ndarray, data: bytes) -> bytes:
    return b"".join(map(codec(data)[1].__getitem__, ids.tolist()))


def _batches(column: pa.Array) -> Iterator[list[bytes]]:
    for _, buf, bounds in kernel.chunks(column):
        whole = buf.tobytes()
        yield [whole[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _mapped(df: DataFrame, text: str, made: dict[str, tuple[str, pa.DataType]], row, path: str) -> DataFrame:
    """df with the columns that row(ids, text bytes, vocabulary) gives."""
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in made]
    carry = [c for c in kept if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry), *(f"`{k}` {v[0]}" for k, v in made.items())])
    vocabulary = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))  # a fixed file of under a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = vocabulary.value
        for batch in batches:
            rows = [row(ids, t, data) for texts in _batches(batch.column(batch.schema.get_field_index(text))) for t, ids in zip(texts, encode_texts(texts, data), strict=True)]
            new = [pa.array([r[i] for r in rows], type=kind) for i, (_, kind) in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carry), *new], names=[*carry, *made])

    return df.select(*carry, F.col(text)).mapInArrow(kernel.freeing(run), schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replace the text by token_ids (array<int>) and token_offsets (array<bigint>: where each token starts, and the end, in UTF-8 bytes)."""
    return _mapped(
        df, text, {"token_ids": ("array<int>", pa.list_(pa.int32())), "token_offsets": ("array<bigint>", pa.list_(pa.int64()))},
        lambda ids, t, data: (ids.astype(np.int32), token_offsets(ids, data)), path,
    )


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Add decoded (binary) from a column of ids; null ids decode to empty bytes."""
    vocabulary = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kept = [c for c in df.columns if c != "decoded"]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(np.array(x.as_py() or [], np.int64), vocabulary.value) for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return df.select(*kept).mapInArrow(kernel.freeing(run), schema)


def encode_digest(df: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, decode again and return the digests: n_tokens, ids_sha256, decoded_sha256, with token_ids if asked for."""
    made: dict[str, tuple[str, pa.DataType]] = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if with_ids:
        made["token_ids"] = ("array<int>", pa.list_(pa.int32()))

    def row(ids: np.ndarray, _: bytes, data: bytes) -> tuple:
        out = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids, data)).hexdigest())
        return (*out, ids.astype(np.int32)) if with_ids else out

    return _mapped(df, text, made, row, path)


if sys.byteorder != "little":  # ids are kept as little-endian bytes
    raise ImportError("a little-endian machine is needed")
