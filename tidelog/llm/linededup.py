"""Substring deduplication by hashing lines, and units within lines.

Lines are normalised (case of A-Z, white space) and hashed, digests are grouped over all
documents, and the occurrence of the smallest (id, place) stays: every other one is removed,
whatever its length, with its original offsets retained. Lines alone can't find a passage
that begins and ends within longer lines, so lines are also cut into units, at words whose
hash no word within REACH words on either side undercuts: a passage gives the same units
wherever in a line it stands. A unit is lost if an earlier document has it, and runs of lost
units of MIN_WORDS words or more are removed, too (of each line EDGE_WORDS words or more). Equal lines have equal units, so the
earliest occurrence of a line or unit is never removed.

Each task sends one occurrence per digest and segment of text, so a line that every
document holds costs its partition a row per segment.

Defined results: null and empty texts are left as they are; of repeated rows the first
physical one stays whole; documents are ranked by id, of whatever type (null last), and then
by place; the spans of removed, put back, give the original text exactly; a document whose whole text is
removed keeps its row with an empty text; an empty table gives an empty table; columns named
removed and n_removed (in any case of letters) are replaced, other columns are carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import bound_batches, cut, exchange_parts, schema_of, unpacked, with_row_key

#: Words on either side that a boundary word's hash undercuts; words that a removed run has at least, if it is no whole line.
REACH, MIN_WORDS = 3, 20
#: A removed run takes at least so many words of each line that is not removed as a line.
EDGE_WORDS = 6
#: Text and documents of a segment.
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 60_000

_SEP, _TABLE = kernel.separators("space"), kernel.byte_table(fold=True)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_CUT = np.uint64(0x2545F4914F6CDD1D)
_LINE = np.uint64(0xDA942042E4DD58B5)
_LAST = np.iinfo(np.int64).max
#: In place of an ordinal: the document repeats lines of its own.
_OWN = np.iinfo(np.uint32).max


class Units:
    """Units of texts: index of the first word of each, digest, and per text the first unit (n + 1); the same of whole lines.

    A text's units have the ordinals 0, 1, ...; its lines those that follow."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.starts, self.ends, self.first_word = kernel.word_spans(buf, bounds, _SEP)
        h = kernel.word_hashes(buf, self.starts, self.ends, _TABLE)
        n = len(h)
        breaks = np.flatnonzero(buf == 10)
        line = np.searchsorted(breaks, self.starts) + np.searchsorted(bounds, self.starts, "right")
        key = kernel.mix(h ^ _CUT)
        cuts = np.ones(n, bool)
        for k in range(1, min(REACH, n - 1) + 1):
            same = line[k:] == line[:-k]
            cuts[k:] &= ~same | (key[k:] < key[:-k])  # of equal words the first is one: a word said over and over gives one unit
            cuts[:-k] &= ~same | (key[:-k] <= key[k:])
        self.new_line = np.append(True, line[1:] != line[:-1])[:n]
        self.first = np.flatnonzero(cuts | self.new_line)
        self.size = np.diff(np.append(self.first, n))
        power = np.full(n + 1, _STEP, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(n + 1, _BACK, np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * power[:n], out=total[1:])

        def digests(first: np.ndarray, size: np.ndarray) -> np.ndarray:
            return kernel.mix((total[first + size] - total[first]) * inverse[first] + size.astype(np.uint64))

        self.digest = digests(self.first, self.size)
        self.first_unit = np.searchsorted(self.first, self.first_word)
        lines = np.flatnonzero(self.new_line)
        self.line_digest = kernel.mix(digests(lines, np.diff(np.append(lines, n))) ^ _LINE)
        self.first_line = np.searchsorted(lines, self.first_word)
        self.line_units = np.append(np.searchsorted(self.first, lines), len(self.first))  # the first unit of each line (and the end)


def _runs(flag: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of set flags."""
    padded = np.concatenate([[False], flag, [False]])
    return np.flatnonzero(padded[1:] != padded[:-1]).reshape(-1, 2)


def removed_spans(units: Units, doc: int, lost: np.ndarray, buf: np.ndarray, start: int, size: int) -> list[tuple[int, int]]:
    """Byte spans, within the text, of lost and repeated lines and of runs of lost units with MIN_WORDS words or more.

    lost has the ordinal of one occurrence of each lost unit and line; all of the document's are meant."""
    a, b = int(units.first_unit[doc]), int(units.first_unit[doc + 1])
    l0, l1 = int(units.first_line[doc]), int(units.first_line[doc + 1])
    gone = np.zeros(b - a, bool)
    flag = np.isin(units.digest[a:b], units.digest[a + lost[lost < b - a]])
    words = np.append(0, np.cumsum(units.size[a:b]))
    for x, y in _runs(flag).tolist():
        gone[x:y] = words[y] - words[x] >= MIN_WORDS
    # A run that spans lines is taken line by line; the lines' own digests tell of short ones.
    piece = np.cumsum(units.new_line[units.first[a:b]] | np.append(True, gone[1:] != gone[:-1])[: b - a])
    gone &= np.bincount(piece, units.size[a:b], int(piece.max(initial=0)) + 1)[piece] >= EDGE_WORDS
    own = units.line_digest[l0:l1]
    again = np.isin(own, own[lost[(lost >= b - a) & (lost != _OWN)] - (b - a)])
    if (lost == _OWN).any():
        again |= ~np.isin(np.arange(l1 - l0), np.unique(own, return_index=True)[1])
    for x, y in zip((units.line_units[l0:l1][again] - a).tolist(), (units.line_units[l0 + 1 : l1 + 1][again] - a).tolist(), strict=True):
        gone[x:y] = True
    last_word = int(units.first_word[doc + 1])
    spans: list[tuple[int, int]] = []
    for x, y in _runs(gone).tolist():
        w0 = int(units.first[a + x])
        w1 = int(units.first[a + y - 1] + units.size[a + y - 1])  # the word after
        inside = not units.new_line[w0]
        begin = int(units.starts[w0]) - start
        if w1 == last_word:  # the white space before goes, too
            stop = size
            floor = spans[-1][1] if spans else 0
            while begin > floor and _SEP[buf[start + begin - 1]]:
                begin -= 1
            if spans and begin == floor:
                begin = spans.pop()[0]
        elif inside and units.new_line[w1]:
            stop = int(units.ends[w1 - 1]) - start  # what stands before in the line keeps its line end
        else:
            stop = int(units.starts[w1]) - start
        spans.append((begin, stop))
    return spans


def _occurrences(docs: DataFrame, parts: int) -> DataFrame:
    """Exchanged by digest: rows of segments (seg, files, rows, idx, ord: what is repeated within) and of losers elsewhere (seg, idx, ord)."""
    names = ["p", "seg", "files", "rows", "digest", "id", "idx", "ord"]
    schema = "p int, seg bigint, files binary, rows binary, digest binary, id binary, idx binary, ord binary"
    kinds = pa.schema([(c, pa.int32() if c == "p" else pa.int64() if c == "seg" else pa.binary()) for c in names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list] = {k: [] for k in ("digest", "id", "idx", "ord", "line", "file", "row")}
        size = docs_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, size, docs_held
            c = {k: np.concatenate(v) for k, v in held.items()}
            order = np.lexsort((c["ord"], c["idx"], c["id"], c["digest"]))
            d, i, x, o, line = (c[k][order] for k in ("digest", "id", "idx", "ord", "line"))
            new = np.append(True, d[1:] != d[:-1])[: len(d)]
            other = new | np.append(True, x[1:] != x[:-1])[: len(d)]  # the digest's first occurrence in a document
            elsewhere, own = other & ~new, np.unique(x[line & ~other])
            seg = part << 32 | made
            lost_x, lost_o = np.append(x[elsewhere], own), np.append(o[elsewhere], np.full(len(own), _OWN))
            rows = [{"p": hash((part, made)) % parts, "seg": seg, "files": c["file"].tobytes(), "rows": c["row"].tobytes(), "idx": lost_x.astype(np.uint16).tobytes(), "ord": lost_o.astype(np.uint32).tobytes()}]
            for r in kernel.scatter((d[new] % np.uint64(parts)).astype(np.int64), parts, {"digest": d[new], "id": i[new], "idx": x[new].astype(np.uint16), "ord": o[new].astype(np.uint32)}):
                r.pop("n")
                rows.append(r | {"seg": seg})
            for v in held.values():
                v.clear()
            made, size, docs_held = made + 1, 0, 0
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            ids = batch.column(2).fill_null(_LAST).to_numpy()
            files, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, buf, bounds in kernel.chunks(batch.column(3)):
                n = len(bounds) - 1
                if docs_held + n > SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield flush()
                u = Units(buf, bounds)
                many = np.diff(u.first_unit)
                for line, digest, first, before in ((False, u.digest, u.first_unit, np.zeros(n, np.int64)), (True, u.line_digest, u.first_line, many)):
                    of = np.repeat(np.arange(n), np.diff(first))
                    held["line"].append(np.full(len(of), line))
                    held["digest"].append(digest)
                    held["id"].append(ids[row : row + n][of])
                    held["idx"].append(of + docs_held)
                    held["ord"].append(np.arange(len(of)) - first[of] + before[of])
                held["file"].append(files[row : row + n])
                held["row"].append(at[row : row + n])
                size, docs_held = size + len(buf), docs_held + n
        if docs_held:
            yield flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            own = np.asarray(batch.column(2).is_valid())
            if own.any():
                yield batch.filter(pa.array(own))
            for k in np.flatnonzero(~own).tolist():
                r = {c: batch.column(c)[k].as_py() for c in ("p", "seg", "digest", "id", "idx", "ord")}
                d = np.frombuffer(r["digest"], np.uint64)
                held.setdefault(r["p"], []).append((d, np.frombuffer(r["id"], np.int64), np.full(len(d), r["seg"]), np.frombuffer(r["idx"], np.uint16), np.frombuffer(r["ord"], np.uint32)))
        while held:
            _, blobs = held.popitem()
            d, i, s, x, o = (np.concatenate(c) for c in zip(*blobs, strict=True))
            del blobs
            d_order = np.argsort(d, kind="stable")
            ds = d[d_order]
            twin = np.append(False, ds[1:] == ds[:-1])
            twin[:-1] |= twin[1:]
            pick = d_order[twin]  # only digests that stand in several segments
            d, i, s, x, o = d[pick], i[pick], s[pick], x[pick], o[pick]
            order = np.lexsort((o, x, s, i, d))
            d, s, x, o = d[order], s[order], x[order], o[order]
            lost = np.append(False, d[1:] == d[:-1]) if len(d) else np.zeros(0, bool)
            s, x, o = s[lost], x[lost], o[lost]
            order = np.argsort(s, kind="stable")
            s, x, o = s[order], x[order], o[order]
            begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
            ends = np.append(begin[1:], len(s))
            rows = [{"p": 0, "seg": int(s[a]), "idx": x[a:b].tobytes(), "ord": o[a:b].tobytes()} for a, b in zip(begin.tolist(), ends.tolist())] if len(s) else []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    sent = docs.select("_file", "_row", "_rank", "text").mapInArrow(kernel.freeing(send), schema)
    return cut(sent.repartitionById(parts, "p").mapInArrow(kernel.freeing(settle), schema).select("seg", "files", "rows", "idx", "ord"))


def _lost_units(occurrences: DataFrame, parts: int) -> DataFrame:
    """_file, _row, lost (ordinals of units and lines, uint32), for documents that lose any."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, list]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                seg, files, rows, idx, o = (batch.column(c)[k].as_py() for c in range(5))
                own = held.setdefault(seg, {"at": [], "idx": [], "ord": []})
                if files is not None:
                    own["at"] = [np.frombuffer(files, np.int64), np.frombuffer(rows, np.int64)]
                own["idx"].append(np.frombuffer(idx, np.uint16))
                own["ord"].append(np.frombuffer(o, np.uint32))
        while held:
            _, own = held.popitem()
            idx, o = np.concatenate(own["idx"]), np.concatenate(own["ord"])
            if not len(idx):
                continue
            order = np.lexsort((o, idx))
            idx, o = idx[order], o[order]
            begin = np.flatnonzero(np.append(True, idx[1:] != idx[:-1]))
            ends = np.append(begin[1:], len(idx)).tolist()
            blobs = [o[a:b].tobytes() for a, b in zip(begin.tolist(), ends)]
            docs = idx[begin]
            yield pa.RecordBatch.from_arrays([pa.array(own["at"][0][docs]), pa.array(own["at"][1][docs]), pa.array(blobs, pa.binary())], names=["_file", "_row", "lost"])

    return occurrences.repartition(parts, "seg").mapInArrow(kernel.freeing(gather), "_file bigint, _row bigint, lost binary")


def _ranked(keyed: DataFrame, id_col: str, text: str) -> DataFrame:
    """text, _file, _row and _rank, which orders documents by id: whole numbers themselves, other types by their place in a sort of the narrow table of ids."""
    found = keyed.select(F.col("_doc").getField(id_col).alias("_id"), "_file", "_row", F.col("_doc").getField(text).alias("text"))
    if dict(found.dtypes)["_id"] in ("bigint", "int", "smallint", "tinyint"):
        return found.select("_file", "_row", F.col("_id").cast("bigint").alias("_rank"), "text")
    order = [F.col("_id").asc_nulls_last(), "_file", "_row"]
    ids = found.select("_id", "_file", "_row")
    place = cut(ids.repartitionByRange(*order).sortWithinPartitions(*order).select("_file", "_row", F.monotonically_increasing_id().alias("_rank")))
    return found.join(place, ["_file", "_row"]).select("_file", "_row", "_rank", "text")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text cleaned, removed (array<struct<start,end>>: code points of the original text) and n_removed (their number)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kept = [c for c in docs.columns if c.lower() not in ("removed", "n_removed")]
    carry = [c for c in kept if c != text]
    keyed = with_row_key(docs.select(*(F.col(f"`{c}`") for c in kept)))
    parts = exchange_parts(keyed)
    lost = _lost_units(_occurrences(_ranked(keyed, id_col, text), parts), parts)
    # All but the text in one struct, so that no name of docs meets one of ours.
    rest = F.struct(*unpacked(carry)) if carry else F.lit(0)
    joined = keyed.join(lost, ["_file", "_row"], "left").select(rest.alias("rest"), F.col("_doc").getField(text).alias("text"), "lost")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, blobs = batch.column(1), batch.column(2)
            hit = np.flatnonzero(np.asarray(blobs.is_valid()))
            removed: list[list] = [[] for _ in range(batch.num_rows)]
            new: dict[int, str] = {}
            if len(hit):
                for row, buf, bounds in kernel.chunks(texts.take(pa.array(hit))):
                    u = Units(buf, bounds)
                    for k in range(len(bounds) - 1):
                        at, start, size = int(hit[row + k]), int(bounds[k]), int(bounds[k + 1] - bounds[k])
                        spans = removed_spans(u, k, np.frombuffer(blobs[at].as_py(), np.uint32).astype(np.int64), buf, start, size)
                        if spans:
                            whole = buf[start : start + size]
                            points = np.append(0, np.cumsum((whole & 0xC0) != 0x80))
                            removed[at] = [{"start": int(points[a]), "end": int(points[b])} for a, b in spans]
                            edges = [0, *(x for s in spans for x in s), size]
                            new[at] = b"".join(whole[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])).decode("utf-8")
            if new:
                values = texts.to_pylist()
                for at, t in new.items():
                    values[at] = t
                texts = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(removed, span), pa.array([len(x) for x in removed], pa.int64())], names=["rest", "text", "removed", "n_removed"])

    schema = schema_of([joined.schema["rest"], joined.schema["text"]], "removed array<struct<start:bigint,end:bigint>>, n_removed bigint")
    out = joined.mapInArrow(kernel.freeing(apply), schema)
    return out.select(*(F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in kept), "removed", "n_removed")
