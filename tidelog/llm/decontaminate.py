"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: each row is a segment of some MB of text with, per term,
the sorted positions at which it stands. Segments are stored in the shared folder. A
phrase is looked up in every segment by itself: its terms' lists are shifted by the terms'
offsets and intersected, rarest list first, so no postings move between tasks. Documents
are kept apart by one position that no term holds. Proximity matches work on the same lists.

The index holds every word of the texts and is stored once; benchmark items are looked up in it block by block, each
block of at most ITEM_BYTES of text being broadcast.

Defined results: a null or empty text has no words, no hits and is clean; repeated rows are
judged each; items without words or with a null id match nothing, items with one id count
once; an empty documents table gives an empty result and an empty benchmark no hits; other
columns of documents are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import bound_batches, cut, unpacked, with_row_key

#: Words of a window.
WINDOW = 13
#: Text of one index segment, and of the items that are looked up at once.
SEGMENT_BYTES, ITEM_BYTES = 16 << 20, 8 << 20
#: A document is contaminated from this share of its words on (one in so many).
SHARE = 20

_SEP, _TABLE = kernel.separators("alnum"), kernel.byte_table(fold=True)
_SEGMENT = "segment string, doc_ids array<string>, n_words binary, firsts binary, terms binary, edges binary, positions binary"


@dataclass
class Segment:
    """A term's positions are positions[edges[k]:edges[k + 1]], terms being sorted."""

    doc_ids: list
    n_words: np.ndarray
    firsts: np.ndarray
    terms: np.ndarray
    edges: np.ndarray
    positions: np.ndarray

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The index of each wanted term, -1 where it has no list."""
        if not len(self.terms):
            return np.full(wanted.shape, -1)
        k = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[k] == wanted, k, -1)

    def list_of(self, k: int) -> np.ndarray:
        return self.positions[self.edges[k] : self.edges[k + 1]]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, position, "right") - 1


def hashes_of(texts: pa.Array) -> list[np.ndarray]:
    """Each text's words as 64-bit hashes."""
    out: list[np.ndarray] = []
    for _, buf, bounds in kernel.chunks(texts):
        starts, ends, first = kernel.word_spans(buf, bounds, _SEP)
        h = kernel.word_hashes(buf, starts, ends, _TABLE)
        out += [h[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the positional index of all words."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {"ids": [], "n": [], "term": [], "at": []}
        size = base = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held, size, base
            n = np.concatenate(held["n"])
            term, at = np.concatenate(held["term"]), np.concatenate(held["at"])
            order = np.argsort(term, kind="stable")
            term, at = term[order], at[order]
            new = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            firsts = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
            row = pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{made}"]), pa.array([held["ids"]], pa.list_(pa.string()))]
                + [pa.array([x.tobytes()], pa.binary()) for x in (n.astype(np.int32), firsts.astype(np.int32), term[new], np.append(new, len(term)).astype(np.int32), at.astype(np.int32))],
                names=["segment", "doc_ids", "n_words", "firsts", "terms", "edges", "positions"],
            )
            made, held, size, base = made + 1, {"ids": [], "n": [], "term": [], "at": []}, 0, 0
            return row

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, buf, bounds in kernel.chunks(batch.column(1)):
                starts, ends, first = kernel.word_spans(buf, bounds, _SEP)
                h = kernel.word_hashes(buf, starts, ends, _TABLE)
                n = np.diff(first)
                at = base + np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
                held["ids"] += ids[row : row + len(n)]
                for key, value in (("n", n), ("term", h), ("at", at)):
                    held[key].append(value)
                size, base = size + len(buf), base + int(n.sum()) + len(n)
                if size >= SEGMENT_BYTES:
                    yield flush()
        if held["ids"]:
            yield flush()

    return cut(docs.select(F.col(id_col).cast("string"), F.col(text)).mapInArrow(kernel.freeing(run), _SEGMENT))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Segment]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = {k: batch.column(k)[i] for k in batch.schema.names}
            of = lambda k, t: np.frombuffer(r[k].as_py(), t)
            yield r["segment"].as_py(), Segment(r["doc_ids"].as_py(), of("n_words", np.int32), of("firsts", np.int32), of("terms", np.uint64), of("edges", np.int32), of("positions", np.int32))


def phrase_starts(segment: Segment, phrases: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(phrase, the positions where it starts), for phrases of one length (a matrix of hashes)."""
    place = segment.places(phrases)
    count = np.where(place >= 0, np.diff(segment.edges)[place] if len(segment.terms) else 0, 0)
    order = np.argsort(count, axis=1, kind="stable")
    for w in np.flatnonzero(count.min(axis=1) > 0):
        found = None
        for o in order[w]:
            own = segment.list_of(place[w, o])
            if found is None:
                found = own - o
                continue
            want = found + o
            k = np.minimum(np.searchsorted(own, want), len(own) - 1)
            found = found[own[k] == want]
            if not len(found):
                break
        if len(found):
            yield int(w), found


class Phrases:
    """The distinct windows of items, by length, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        owners: dict[int, dict[bytes, set[str]]] = {}
        for item, h in items:
            length = min(window, len(h))
            for i in range(len(h) - length + 1 if length else 0):
                owners.setdefault(length, {}).setdefault(h[i : i + length].tobytes(), set()).add(item)
        self.by_length = {n: (np.frombuffer(b"".join(found), np.uint64).reshape(-1, n), [sorted(x) for x in found.values()]) for n, found in owners.items()}


def _matches(index: DataFrame, phrases: Phrases, all_docs: bool) -> DataFrame:
    """Per document with a match (or per document): segment, ord, doc_id, n_words, items, from and to (the hit word ranges)."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)  # from items of at most ITEM_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, seg in _segments(batches):
            hits: dict[int, tuple[set, list, list]] = {}
            for length, (matrix, owners) in shared.value.by_length.items():
                for w, starts in phrase_starts(seg, matrix):
                    for d, s in zip(seg.doc_of(starts).tolist(), starts.tolist()):
                        items, a, b = hits.setdefault(d, (set(), [], []))
                        items.update(owners[w])
                        a.append(s - int(seg.firsts[d]))
                        b.append(s - int(seg.firsts[d]) + length)
            docs = range(len(seg.doc_ids)) if all_docs else sorted(hits)
            rows = [(d, *hits.get(d, ((), [], []))) for d in docs]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int32()), pa.array([seg.doc_ids[r[0]] for r in rows], pa.string()),
                    pa.array([int(seg.n_words[r[0]]) for r in rows], pa.int64()), pa.array([sorted(r[1]) for r in rows], pa.list_(pa.string())),
                    pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                ],
                names=["segment", "ord", "doc_id", "n_words", "items", "from", "to"],
            )

    return index.mapInArrow(kernel.freeing(run), "segment string, ord int, doc_id string, n_words bigint, items array<string>, `from` array<int>, `to` array<int>")


def _covered(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the union of the ranges."""
    if not len(a):
        return 0
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    return int(np.maximum(0, b - np.maximum(a, np.append(0, b[:-1]))).sum())


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {k: batch.column(k) for k in batch.schema.names}
        rows = []
        for i in range(batch.num_rows):
            items = sorted(set(c["items"][i].as_py()))
            hit = _covered(np.array(c["from"][i].as_py(), np.int64), np.array(c["to"][i].as_py(), np.int64))
            n = c["n_words"][i].as_py()
            rows.append((c["doc_id"][i].as_py(), n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and SHARE * hit >= n, items))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))


_VERDICT = "doc_id string, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"


def _items(benchmark: DataFrame, item_col: str, text: str) -> list[tuple[str, np.ndarray]]:
    table = benchmark.select(F.col(item_col).cast("string"), F.col(text)).where(F.col(item_col).isNotNull() & F.col(text).isNotNull()).toArrow()
    return list(zip(table.column(0).to_pylist(), hashes_of(table.column(1)), strict=True)) if table.num_rows else []


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id (of id_col's type), n_words, n_hit, n_items, items_sha256, contaminated, items."""
    whole = F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0))).first()[0]
    blocks = -(-size // ITEM_BYTES)
    index = build_index(docs, id_col, text)
    if blocks <= 1:
        found = _matches(index, Phrases(_items(benchmark, item_col, item_text)), True)
        return found.mapInArrow(kernel.freeing(_verdicts), _VERDICT).withColumn("doc_id", whole)
    parts = []
    for b in range(2 * blocks):  # hash blocks of about half the bound
        own = benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(2 * blocks)) == b)
        parts.append(cut(_matches(index, Phrases(_items(own, item_col, item_text)), b == 0)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("segment", "ord").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"),
        F.flatten(F.collect_list("from")).alias("from"), F.flatten(F.collect_list("to")).alias("to"),
    )
    return merged.select("segment", "ord", "doc_id", "n_words", "items", "from", "to").mapInArrow(kernel.freeing(_verdicts), _VERDICT).withColumn("doc_id", whole)


def phrase_matches(index: DataFrame, items: list[tuple[str, str]]) -> DataFrame:
    """Exact phrase matches: doc_id, item, start, end (words), for each whole text of items."""
    hashed = list(zip([i for i, _ in items], hashes_of(pa.array([t for _, t in items], pa.string())), strict=True))
    parts = [_matches(index, Phrases([one], max(1, len(one[1]))), False).select("doc_id", "items", F.arrays_zip("from", "to").alias("at")) for one in hashed if len(one[1])]
    if not parts:
        return index.sparkSession.createDataFrame([], "doc_id string, item string, start int, end int")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("doc_id", F.get("items", 0).alias("item"), F.explode("at").alias("at")).select("doc_id", "item", F.col("at.from").alias("start"), F.col("at.to").alias("end"))


def proximity_matches(index: DataFrame, text: str, slop: int) -> DataFrame:
    """doc_id, start, end: for each occurrence of the text's rarest word, the shortest stretch around it of at most slop words that holds all of the text's words."""
    terms = np.unique(hashes_of(pa.array([text]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, seg in _segments(batches):
            place = seg.places(terms)
            out: list[tuple] = []
            if len(terms) and (place >= 0).all():
                lists = sorted((seg.list_of(k) for k in place), key=len)
                for p, d in zip(lists[0].tolist(), seg.doc_of(lists[0]).tolist()):
                    first = int(seg.firsts[d])
                    low, high = max(p - slop + 1, first), min(p + slop, first + int(seg.n_words[d]))
                    near = [(int(x), t) for t, own in enumerate(lists) for x in (own[np.searchsorted(own, low) : np.searchsorted(own, high)] if t else [p])]
                    if best := _shortest(sorted(near), len(lists), slop):
                        out.append((seg.doc_ids[d], best[0] - first, best[1] + 1 - first))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))], names=["doc_id", "start", "end"])

    return index.mapInArrow(kernel.freeing(run), "doc_id string, start int, `end` int")


def _shortest(near: list[tuple[int, int]], terms: int, slop: int) -> tuple[int, int] | None:
    """The shortest (first, last) position of near that holds every term within slop words."""
    count, have, a, best = [0] * terms, 0, 0, None
    for position, t in near:
        have += not count[t]
        count[t] += 1
        while have == terms:
            first = near[a][0]
            if position - first < slop and (best is None or position - first < best[1] - best[0]):
                best = (first, position)
            count[near[a][1]] -= 1
            have -= not count[near[a][1]]
            a += 1
    return best


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, each physical row judged by itself, with all their columns as they are."""
    keyed = with_row_key(docs)
    judged = keyed.select(F.concat_ws(":", "_file", "_row").alias("key"), F.col("_doc").getField(text).alias("text"))
    bad = judge(judged, benchmark, "key").where("contaminated").select(F.split("doc_id", ":").alias("k"))
    bad = bad.select(F.col("k")[0].cast("long").alias("_file"), F.col("k")[1].cast("long").alias("_row"))
    return keyed.join(bad, ["_file", "_row"], "left_anti").select(*unpacked(docs.columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
v AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item, n, w[i : i + n - 1] AS g FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM v)),
y AS (SELECT rid, i, n, w[i : i + n - 1] AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d), (SELECT DISTINCT n FROM x) WHERE i + n - 1 <= len(w)),
h AS (SELECT DISTINCT rid, item, i, x.n FROM y JOIN x ON x.n = y.n AND x.g = y.g),
p AS (SELECT rid, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS k FROM h) GROUP BY rid),
q AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN q USING (rid)
"""
