"""N-gram Jaccard self-join by prefix filters under several global token orders.

Sets are the distinct five-word shingles of a text, as 64-bit hashes. Equal sets form one
class. A global order puts every token at a place by hash, frequent tokens behind all
others; two sets whose Jaccard similarity reaches the threshold share a token of their
prefixes under every such order. Posting lists of the first order's prefix tokens give
candidates, the filters of the further orders are intersected with them, and what is left
is verified on the whole sets.

A long posting list never gives all its pairs. Its members are verified against one pivot.
Lists whose members are still in different components are gathered into families, whose
sets meet in cells of bounded size; only pairs in different components are compared there.
Where the cells would be too many, lists get new pivots first. No link between components is
lost by that, as pairs within one component can't change it.

Tokens are counted over all documents, in cells, and the orders put tokens of higher
frequency classes later; a map of bounded size tells the classes. Only a token's place
depends on it, never whether a pair is found.

Defined results: null, empty and blank texts have empty sets, are linked with nothing and
are their own component; texts of fewer words than a shingle have one token, the whole
sequence; repeated rows and ids are rows of one class if their texts agree; a null id is
ignored for the smallest id unless all are null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .graph import components, spread_join
from .store import bound_batches, cut, exchange_parts, schema_of, unpacked, with_row_key

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Bounds of frequency classes, in sets that hold a token. The map of CLASS_CELLS cells (two bits each) uses, in each
#: counting partition, the three lowest of which no more than two fifths of the cells reach the first.
FREQUENT, CLASS_CELLS = (2, 6, 24, 96, 384, 1536), 1 << 26
#: Members of a posting list up to which all pairs are taken.
SHORT_LIST = 24
#: Sets of a block of a family; sets sent to cells per candidate, beyond which lists get new pivots, so many times at most.
BLOCK, SENT_SHARE, PIVOT_ROUNDS = 128, 8, 6
#: Text that one task gathers before it sends its tokens on.
GATHER_BYTES = 8 << 20
#: Bits of the bitmap that says which rows are candidates, per candidate and at most.
BITMAP_SHARE, BITMAP_BITS = 32, 1 << 27
ORDERS = 3

_SEP, _TABLE = kernel.separators("space"), kernel.byte_table(fold=True)
_STEP = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]
_ORDER = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D, 0xDA942042E4DD58B5)]
_CELLS = 27  # bits of a token's cell in a counting partition
_HIGH = _CELLS - 16


def shingle_sets(buf: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    starts, ends, first = kernel.word_spans(buf, bounds, _SEP)
    h = kernel.word_hashes(buf, starts, ends, _TABLE)
    edges = first.tolist()
    s = np.zeros(0, np.uint64)
    if len(h) >= WORDS:
        s = h[: len(h) - WORDS + 1] * _STEP[WORDS - 1]
        for k in range(1, WORDS):
            s = s + h[k : len(h) - WORDS + 1 + k] * _STEP[WORDS - 1 - k]
        s = kernel.mix(s)
    for a, b in zip(edges, edges[1:]):
        if b - a >= WORDS:
            yield np.unique(s[a : b - WORDS + 1])
        elif b > a:
            yield np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def order_keys(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Each token's place in a global order: by frequency class, then by hash."""
    return (kernel.mix(tokens ^ _ORDER[order]) >> np.uint64(2)) | (classes << np.uint64(62))


def _cells(tokens: np.ndarray, parts: int) -> np.ndarray:
    """part << _CELLS | cell: where a token is counted."""
    return (tokens % np.uint64(parts)) << np.uint64(_CELLS) | (tokens >> np.uint64(64 - _CELLS))


def _cell_shift(parts: int) -> int:
    """Bits by which cells are coarsened in the map."""
    return next(k for k in range(_CELLS) if (parts << _CELLS) >> k <= CLASS_CELLS or k == _CELLS - 2)


def _classes(tokens: np.ndarray, parts: int, known: np.ndarray) -> np.ndarray:
    """The frequency class (0 to 3) of each token."""
    if not len(known):
        return np.zeros(len(tokens), np.uint64)
    at = (_cells(tokens, parts) >> np.uint64(_cell_shift(parts))).astype(np.int64)
    return (known[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3).astype(np.uint64)


def _size_code(n: int) -> int:
    """Sizes whose codes differ by over SIZE_BAND differ by more than the threshold allows."""
    return int(np.log(n) / np.log(1.05))


SIZE_BAND = int(np.log(100 / PERCENT) / np.log(1.05)) + 1


def _sets(docs: DataFrame, carry: list[str], text: str, parts: int) -> DataFrame:
    """Rows of documents (carry, n, cls; least null) and, exchanged by cell, a part's map (p, blob) of its tokens' frequency classes."""
    schema = schema_of([docs.schema[c] for c in carry], "n bigint, cls bigint, least bigint, p int, blob binary")
    kinds = pa.schema([("n", pa.int64()), ("cls", pa.int64()), ("least", pa.int64()), ("p", pa.int32()), ("blob", pa.binary())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[np.ndarray] = []
        seen: set[int] = set()
        size, spread = 0, 7919 * TaskContext.get().partitionId()
        types = None

        def flush() -> pa.RecordBatch:
            nonlocal size
            cells = np.sort(_cells(np.concatenate(held), parts))
            edges = np.searchsorted(cells, np.arange(parts + 1, dtype=np.uint64) << np.uint64(_CELLS))
            ps = np.flatnonzero(edges[1:] > edges[:-1])
            blobs = []
            for p in ps:
                own = cells[edges[p] : edges[p + 1]]
                high = np.bincount((own >> np.uint64(16)).astype(np.int64) & ((1 << _HIGH) - 1), minlength=1 << _HIGH).astype(np.uint32)
                blobs.append(high.tobytes() + own.astype(np.uint16).tobytes())
            held.clear()
            seen.clear()
            size = 0
            none = pa.nulls(len(ps), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(ps), t) for t in types), none, none, none, pa.array(ps.astype(np.int32)), pa.array(blobs, pa.binary())], names=[*carry, *kinds.names])

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(carry))]
            n, cls = [], []
            for _, buf, bounds in kernel.chunks(batch.column(len(carry))):
                for s in shingle_sets(buf, bounds):
                    n.append(len(s))
                    cls.append(class_of(s))
                    if len(s) and cls[-1] not in seen:
                        seen.add(cls[-1])
                        held.append(s)
                size += len(buf)
                if size >= GATHER_BYTES and held:
                    yield flush()
            spread += len(n)
            none = pa.nulls(len(n), pa.int64())
            p = (np.arange(len(n)) + spread) % parts
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none, pa.array(p.astype(np.int32)), pa.nulls(len(n), pa.binary())], names=[*carry, *kinds.names])
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        types = None
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(carry))]
            blobs = batch.column(len(carry) + 4)
            rows = np.flatnonzero(np.asarray(blobs.is_null()))
            if len(rows):
                yield batch.take(pa.array(rows))
            for i in np.flatnonzero(np.asarray(blobs.is_valid())):
                raw = blobs[int(i)].as_py()
                high = np.repeat(np.arange(1 << _HIGH, dtype=np.uint32), np.frombuffer(raw, np.uint32, 1 << _HIGH))
                held.setdefault(batch.column(len(carry) + 3)[int(i)].as_py(), []).append(high << np.uint32(16) | np.frombuffer(raw, np.uint16, offset=4 << _HIGH))
        while held:
            p, own = held.popitem()
            cells, counted = np.unique(np.concatenate(own), return_counts=True)
            shift = _cell_shift(parts)
            level = np.zeros((1 << _CELLS) >> shift, np.uint8)
            np.maximum.at(level, cells >> np.uint32(shift), np.searchsorted(FREQUENT, counted, "right").astype(np.uint8))
            reached = np.cumsum(np.bincount(level, minlength=len(FREQUENT) + 1)[::-1])[::-1]
            first = int(np.argmax(reached[1:] <= len(level) * 2 // 5)) + 1 if (reached[1:] <= len(level) * 2 // 5).any() else len(FREQUENT)
            code = np.clip(level.astype(np.int8) - (first - 1), 0, 3).astype(np.uint8).reshape(-1, 4)
            packed = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types), none, none, pa.array([0]), pa.array([p], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=[*carry, *kinds.names])

    sent = docs.select(*carry, F.col(text)).mapInArrow(kernel.freeing(tokens), schema)
    return cut(sent.repartitionById(parts, "p").mapInArrow(kernel.freeing(count), schema))


def _frequent(sets: DataFrame, parts: int) -> np.ndarray:
    """The map of frequency classes, two bits per cell, CLASS_CELLS at most."""
    span = ((1 << _CELLS) >> _cell_shift(parts)) // 4
    out = np.zeros(parts * span, np.uint8)
    table = sets.where("least is not null").select("p", "blob").toArrow()
    for p, blob in zip(table.column("p").to_pylist(), table.column("blob"), strict=True):
        out[p * span : (p + 1) * span] = np.frombuffer(blob.as_buffer(), np.uint8)
    return out


def _candidates(docs: DataFrame, text: str, parts: int, frequent, out_parts: int) -> DataFrame:
    """Pairs (list null: a, b, salt) and members of long lists (list, a, code), from posting lists of the first order's prefixes."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            token = np.concatenate([t for t, _, _ in held])
            many = [len(t) for t, _, _ in held]
            cls = np.repeat(np.array([c for _, c, _ in held], np.int64), many)
            code = np.repeat(np.array([c for _, _, c in held], np.uint16), many)
            rows = list(kernel.scatter((token % np.uint64(out_parts)).astype(np.int64), out_parts, {"token": (token >> np.uint64(32)).astype(np.uint32), "cls": cls, "code": code}))
            held.clear()
            seen.clear()
            size = 0
            return pa.RecordBatch.from_pylist([{k: r[k] for k in ("p", "token", "cls", "code")} for r in rows], pa.schema([("p", pa.int32()), ("token", pa.binary()), ("cls", pa.binary()), ("code", pa.binary())]))

        for batch in batches:
            for _, buf, bounds in kernel.chunks(batch.column(0)):
                for s in shingle_sets(buf, bounds):
                    if not len(s) or (c := class_of(s)) in seen:
                        continue
                    seen.add(c)
                    k = prefix_length(len(s))
                    keys = order_keys(s, _classes(s, parts, frequent.value), 0)
                    held.append((s[np.argpartition(keys, k - 1)[:k]] if k < len(s) else s, c, _size_code(len(s))))
                size += len(buf)
                if size >= GATHER_BYTES and held:
                    yield flush()
        if held:
            yield flush()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                p, t, c, z = (batch.column(k)[i].as_py() for k in range(4))
                held.setdefault(p, []).append((np.frombuffer(t, np.uint32), np.frombuffer(c, np.int64), np.frombuffer(z, np.uint16)))
        for blobs in held.values():
            yield from _pairs_of(*(np.concatenate(x) for x in zip(*blobs, strict=True)))

    sent = docs.select(F.col(text)).mapInArrow(kernel.freeing(tokens), "p int, token binary, cls binary, code binary")
    return cut(sent.repartitionById(out_parts, "p").mapInArrow(kernel.freeing(pairs), "list bigint, a bigint, b bigint, salt int, code int"))


_PAIR = pa.schema([("list", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("salt", pa.int32()), ("code", pa.int32())])


def _pair_batch(a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((salt, b, a))
    a, b, salt = a[order], b[order], salt[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    n = int(new.sum())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(a[new]), pa.array(b[new]), pa.array(salt[new].astype(np.int32)), pa.nulls(n, pa.int32())], schema=_PAIR)


def _pairs_of(token: np.ndarray, cls: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of the posting lists of one partition."""
    order = np.lexsort((cls, token))
    token, cls, code = token[order], cls[order], code[order]
    new = np.append(True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]))
    token, cls, code = token[new], cls[new], code[new].astype(np.int32)
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(begin, len(token)))
    out_a, out_b, out_s = [], [], []
    for m in range(2, SHORT_LIST + 1):
        own = begin[length == m]
        if len(own):
            i, j = np.triu_indices(m, 1)
            a, b = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
            near = np.abs(code[a] - code[b]) <= SIZE_BAND
            out_a.append(cls[a[near]])
            out_b.append(cls[b[near]])
            out_s.append(np.zeros(int(near.sum()), np.int32))
    lists: set[int] = set()
    for s, m in zip(begin[length > SHORT_LIST].tolist(), length[length > SHORT_LIST].tolist()):
        c, z = cls[s : s + m], code[s : s + m]
        # Bands of sizes overlap by half, so that any two sizes near enough share one.
        for band in range(int(z.min()) // SIZE_BAND - 1, int(z.max()) // SIZE_BAND + 1):
            inside = (z >= band * SIZE_BAND) & (z < (band + 2) * SIZE_BAND + 1)
            own = c[inside]
            if len(own) < 2:
                continue
            name = class_of(own)
            if name in lists:
                continue
            lists.add(name)
            out_a.append(np.full(len(own) - 1, own[0]))
            out_b.append(own[1:])
            out_s.append(1 + np.arange(len(own) - 1, dtype=np.int32) // 256)
            if len(own) > 2:
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(own), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(z[inside])], schema=_PAIR)
    if out_a:
        yield _pair_batch(np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_s))


def _bitmap(rows: DataFrame, n: int, parts: int) -> tuple[int, np.ndarray]:
    """A bitmap of the row keys, of bounded size: clear bits are surely no candidates."""
    bits = min(BITMAP_BITS, max(1 << 16, 1 << (n * BITMAP_SHARE - 1).bit_length()))
    span = max(1024, -(-bits // parts) // 8 * 8 + 8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).to_numpy()
            for p in np.unique(batch.column(0).to_numpy()).tolist():
                own = slices.setdefault(p, np.zeros(span, bool))
                own[at[batch.column(0).to_numpy() == p] - p * span] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int64()), pa.array([np.packbits(x).tobytes() for x in slices.values()], pa.binary())], names=["p", "bits"])

    bit = F.pmod(F.xxhash64("_file", "_row"), F.lit(bits))
    table = rows.select(F.floor(bit / span).cast("long").alias("p"), bit.cast("long").alias("at")).repartition(parts, "p").mapInArrow(kernel.freeing(build), "p bigint, bits binary").toArrow()
    out = np.zeros((-(-bits // span)) * span, bool)
    for p, b in zip(table.column("p").to_pylist(), table.column("bits").to_pylist(), strict=True):
        out[p * span : (p + 1) * span] = np.unpackbits(np.frombuffer(b, np.uint8))[:span].astype(bool)
    return bits, np.packbits(out)


def _blobs(docs: DataFrame, text: str, parts: int, frequent, bits: int, bitmap: np.ndarray) -> DataFrame:
    """cls, tokens (48 bits each, sorted), prefixes (32 bits of each token of the further orders' prefixes), of the candidate rows."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            wanted = np.flatnonzero(shared.value[at >> 3] >> (7 - (at & 7)) & 1)
            rows = []
            for _, buf, bounds in kernel.chunks(batch.column(1).take(pa.array(wanted))):
                for s in shingle_sets(buf, bounds):
                    if not len(s):
                        continue
                    k, rare = prefix_length(len(s)), _classes(s, parts, frequent.value)
                    keys = [order_keys(s, rare, order) for order in range(1, ORDERS)]
                    heads = [np.sort(s[np.argpartition(x, k - 1)[:k]] if k < len(s) else s) >> np.uint64(32) for x in keys]
                    rows.append((class_of(s), pack(s), np.concatenate(heads).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["cls", "tokens", "prefixes"])

    return cut(docs.select(F.pmod(F.xxhash64("_file", "_row"), F.lit(bits)).cast("long"), F.col(text)).mapInArrow(kernel.freeing(run), "cls bigint, tokens binary, prefixes binary"))


def pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of sorted tokens, as 32 and 16 bits."""
    return (tokens >> np.uint64(32)).astype(np.uint32).tobytes() + (tokens >> np.uint64(16)).astype(np.uint16).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) << np.uint64(16) | np.frombuffer(blob, np.uint16, n, 4 * n)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) < len(b):
        a, b = b, a
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _meet(pairs: DataFrame, blobs: DataFrame, blob: str, parts: int, keep, unpacked_blob) -> DataFrame:
    """a, b, salt of the pairs (a, b, salt) whose blobs keep() accepts. A cell (a, salt) gets a's blob once and those of its partners."""
    cells = pairs.select("a", "salt", F.col("b").alias("cls")).union(pairs.select("a", "salt", F.col("a").alias("cls")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[int, bytes]] = {}
        for batch in batches:
            a, salt, cls = (batch.column(i).to_pylist() for i in range(3))
            for k in range(batch.num_rows):
                held.setdefault((a[k], salt[k]), {})[cls[k]] = batch.column(3)[k].as_py()
        found: list[tuple[int, int, int]] = []
        while held:
            (hub, salt), members = held.popitem()
            own = unpacked_blob(members.pop(hub))
            found += [(hub, other, salt) for other, theirs in members.items() if keep(own, unpacked_blob(theirs))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "salt"])

    joined = cells.join(blobs.select("cls", blob), "cls").select("a", "salt", "cls", blob)
    return cut(joined.repartition(parts, "a", "salt").mapInArrow(kernel.freeing(run), "a bigint, b bigint, salt int"))


def _share_prefixes(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    return all(bool((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).any()) for x, y in zip(a, b, strict=True))


def _verify(pairs: DataFrame, blobs: DataFrame, parts: int) -> DataFrame:
    """The links (u, v) among pairs (a, b, salt): the further orders' filters are intersected first, so only pairs that share a token under every order get whole sets."""
    left = _meet(pairs, blobs, "prefixes", parts, _share_prefixes, _prefixes)
    return _meet(left, blobs, "tokens", parts, similar, unpack).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _prefixes(blob: bytes) -> list[np.ndarray]:
    return list(np.frombuffer(blob, np.uint32).reshape(ORDERS - 1, -1))


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """list, a, code, root, base, of lists whose members are in different components; base is the component of the most."""
    at = members.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("list", "a", "code", F.coalesce("root", "a").alias("root"))
    groups = at.groupBy("list", "root").agg(F.count("*").alias("size"))
    base = groups.groupBy("list").agg(F.max(F.struct("size", "root")).alias("base"), F.count("*").alias("groups"))
    return spread_join(at, base.where("groups > 1").select("list", F.col("base.root").alias("base")), "list", F.col("a"))


def _new_pivots(at: DataFrame) -> DataFrame:
    """Pairs of each list's next pivot, the least member of its largest component but the base, with members of other components."""
    outside = at.where("root <> base").groupBy("list", "root").agg(F.count("*").alias("size"), F.min("a").alias("least"))
    pivot = outside.groupBy("list").agg(F.max_by(F.struct("least", "root"), F.struct("size", "root")).alias("p")).select("list", F.col("p.least").alias("x"), F.col("p.root").alias("rx"))
    met = spread_join(at, pivot, "list", F.col("a")).where("root <> rx").select(F.col("x").alias("a"), F.col("a").alias("b")).distinct()
    return met.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))


def _families(at: DataFrame) -> DataFrame:
    """a, code, root, lists, family, outer (in some list not in the base), k, l, block, of open lists; lists that share members are one family.

    A family has k outer and l inner blocks; members are dealt to them by hash."""
    docs = at.groupBy("a").agg(F.first("code").alias("code"), F.first("root").alias("root"), F.collect_set("list").alias("lists"), F.max((F.col("root") != F.col("base")).cast("int")).alias("outer"))
    of_list = components(at.select(F.col("list").alias("u"), F.col("a").alias("v"))).select("node", F.col("root").alias("_family"))
    named = cut(docs.join(of_list, F.col("a") == F.col("node"), "left").select("a", "code", "root", "lists", "outer", F.coalesce("_family", "a").alias("family")))
    blocks = lambda n: F.ceil(F.sum(n) / BLOCK).cast("int")
    shape = named.groupBy("family").agg(blocks(F.col("outer")).alias("k"), blocks(1 - F.col("outer")).alias("l")).where("k > 0")
    return spread_join(named, shape, "family", F.col("a")).withColumn("block", F.pmod(F.xxhash64("a", F.lit(1)), F.when(F.col("outer") == 1, F.col("k")).otherwise(F.col("l"))).cast("int"))


def _cells_of(f: DataFrame) -> DataFrame:
    """family, i, j, a, ...: each member with every cell it belongs to. Cell (i, j) holds outer block i and, for j >= 0, outer block j >= i, else inner block -1 - j."""
    pair = lambda x, y: F.struct(x.cast("int").alias("i"), y.cast("int").alias("j"))
    others = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: pair(F.least(x, F.col("block")), F.greatest(x, F.col("block"))))
    inner = F.when(F.col("l") > 0, F.transform(F.sequence(F.lit(1), F.greatest("l", F.lit(1))), lambda x: pair(F.col("block"), -x)))
    mine = F.when(F.col("outer") == 1, F.concat(others, F.coalesce(inner, F.expr("array()").cast("array<struct<i:int,j:int>>")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: pair(x, -1 - F.col("block"))))
    return f.withColumn("_c", F.explode(mine)).select("family", "_c.i", "_c.j", F.col("a").alias("cls"), "code", "root", "lists")


def _verify_cells(cells: DataFrame, blobs: DataFrame, parts: int) -> DataFrame:
    """Links between members of a cell that share a list and are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            c = [batch.column(i) for i in range(batch.num_columns)]
            for k in range(batch.num_rows):
                held.setdefault(tuple(x[k].as_py() for x in c[:3]), []).append(tuple(x[k].as_py() for x in c[3:]))
        u, v = [], []
        while held:
            for a, b in _cell_links(held.popitem()[1]):
                u.append(a)
                v.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    joined = cells.join(blobs, "cls").select("family", "i", "j", "cls", "code", "root", "lists", "tokens", "prefixes")
    return cut(joined.repartition(parts, "family", "i", "j").mapInArrow(kernel.freeing(run), "u bigint, v bigint"))


def _cell_links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    parent: dict[int, int] = {r[2]: r[2] for r in rows}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, tuple] = {}

    def of(k: int) -> tuple:
        if k not in sets:
            sets[k] = (unpack(rows[k][4]), _prefixes(rows[k][5]))
        return sets[k]

    code, roots = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
    open_ = _shared([r[3] for r in rows]) & (np.abs(code[:, None] - code) <= SIZE_BAND) & (roots[:, None] != roots)
    for x, y in np.argwhere(np.triu(open_, 1)).tolist():
        if find(rows[x][2]) == find(rows[y][2]):
            continue
        (a, pa_), (b, pb_) = of(x), of(y)
        if _share_prefixes(pa_, pb_) and similar(a, b):
            parent[find(rows[x][2])] = find(rows[y][2])
            yield rows[x][0], rows[y][0]


def _shared(lists: list[list[int]]) -> np.ndarray:
    """Which members have a list in common."""
    names, at = np.unique(np.concatenate([np.array(x, np.int64) for x in lists]), return_inverse=True)
    member = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    out = np.zeros((len(lists), len(lists)), bool)
    for first in range(0, len(names), 1024):
        inside = (at >= first) & (at < first + 1024)
        of = np.zeros((len(lists), 1024), np.float32)
        of[member[inside], at[inside] - first] = 1
        out |= of @ of.T > 0
    return out


def link_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, carry, n_shingles, component_id (the smallest id reachable by links). Carried columns win no name: one called n_shingles or component_id is left out."""
    keyed = with_row_key(docs)
    carried = F.struct(*unpacked(list(carry))) if carry else F.lit(0)
    narrow = keyed.select(F.col("_doc").getField(id_col).alias("id"), F.col("_doc").getField(text).alias("text"), "_file", "_row", carried.alias("carried"))
    found = _components_of(narrow, ("carried",) if carry else ())
    left = [c for c in carry if c.lower() not in (id_col.lower(), "n_shingles", "component_id")]
    return found.select(F.col("id").alias(id_col), *(F.col("carried").getField(c).alias(c) for c in left), "n_shingles", "component_id")


def _components_of(keyed: DataFrame, carry: tuple[str, ...] = (), with_root: bool = False) -> DataFrame:
    """id, _file, _row, carry, n_shingles, component_id of rows (id, text, _file, _row), and with_root component_root, which names the component where ids repeat."""
    spark: SparkSession = keyed.sparkSession
    bound_batches(spark)
    id_col, text = "id", "text"
    names = [id_col, "_file", "_row", *carry]
    parts = exchange_parts(keyed)
    sets = _sets(keyed, names, text, parts)
    rows = sets.where("least is null").select(*names, "n", "cls")
    frequent = spark.sparkContext.broadcast(_frequent(sets, parts))  # CLASS_CELLS quarters of a byte at most
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out_parts = exchange_parts(keyed, total * (100 - PERCENT) // 100)
    found = _candidates(keyed, text, parts, frequent, out_parts)
    pairs = cut(found.where("list is null").groupBy("a", "b").agg(F.min("salt").alias("salt")))
    members = cut(found.where("list is not null").select("list", "a", "code").distinct())
    in_play = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).union(members.select(F.col("a").alias("cls"))).distinct()
    first_row = rows.where("n > 0").groupBy("cls").agg(F.min(F.struct("_file", "_row")).alias("k"))
    chosen = cut(first_row.join(in_play, "cls").select("k._file", "k._row"))
    n = chosen.count()
    roots = None
    if n:
        bits, bitmap = _bitmap(chosen, n, parts)
        blobs = _blobs(keyed, text, parts, frequent, bits, bitmap)
        known = lambda found: found.select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = components(_verify(pairs, blobs, out_parts))
        for k in range(PIVOT_ROUNDS + 1):
            at = cut(_open_members(members, roots))
            if at.isEmpty():
                break
            cells = cut(_cells_of(_families(at)))
            if k == PIVOT_ROUNDS or cells.count() <= SENT_SHARE * n:
                roots = components(known(roots).union(_verify_cells(cells, blobs, out_parts)))
                break
            roots = components(known(roots).union(_verify(_new_pivots(at), blobs, out_parts)))
    classes = rows.where("n > 0").groupBy("cls", "n").agg(F.min(id_col).alias("least"), F.count("*").alias("size"))
    if roots is None:
        named = classes.where("size > 1").select("cls", "n", F.col("cls").alias("root"), F.col("least").alias("component_id"))
    else:
        rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "n", "least", "size", F.coalesce("root", "cls").alias("root"))
        linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("size").alias("docs")).where("docs > 1").drop("docs")
        named = spread_join(rooted, linked, "root", F.col("cls")).select("cls", "n", "root", "component_id")
    named = cut(named)
    out = rows.alias("r").join(named.alias("c"), (F.col("r.cls") == F.col("c.cls")) & (F.col("r.n") == F.col("c.n")) & (F.col("r.n") > 0), "left")
    root = [F.coalesce("c.root", "r.cls").alias("component_root")] if with_root else []
    return out.select(*(F.col(f"r.{c}").alias(c) for c in names), F.col("r.n").alias("n_shingles"), F.coalesce("c.component_id", f"r.{id_col}").alias("component_id"), *root)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays, with all its columns as they are: of its smallest id the first physical row. Rows without words all stay."""
    keyed = with_row_key(docs)
    narrow = keyed.select(F.col("_doc").getField(id_col).alias("id"), F.col("_doc").getField(text).alias("text"), "_file", "_row")
    found = _components_of(narrow, with_root=True)
    order = F.struct(F.col("id").isNull().alias("x"), "id", "_file", "_row")
    first = found.where("n_shingles > 0").groupBy("component_root").agg(F.min(order).alias("k")).select("k._file", "k._row")
    kept = first.union(found.where("n_shingles = 0").select("_file", "_row"))
    return keyed.join(kept, ["_file", "_row"], "left_semi").select(*unpacked(docs.columns))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
t AS MATERIALIZED (SELECT rid, len(g) AS n, unnest(g) AS t FROM s),
k AS (SELECT a.rid AS x, b.rid AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.rid < b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM k WHERE 100 * c >= 80 * (m + n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, rid AS other FROM s UNION SELECT r.rid, e.y FROM r JOIN e ON r.other = e.x)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN s o ON o.rid = r.other GROUP BY r.rid) c ON c.rid = s.rid
"""
