"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its distinct
words and their beginnings (of PREFIXES bytes, so that inflected forms share features); the document's is their noisy-or, 1 - prod(1 - p).
A text of more sentences than a window (the WINDOW quantile of the sampled documents' numbers) scores as its
most offending window, as the sentences' background alone would add up in a long clean text. Windows overlap by half. Word weights are trained from
document labels only, on a bounded sample of labelled rows, and then score every sentence
of every document, so the offending sentences are located without sentence labels.

The fit is bounded by SAMPLE_ROWS labelled rows (those of the smallest hashes of their ids) and, so that one task
can hold them, by SAMPLE_BYTES of text in all: rows are taken in that order, of whatever length, until their texts
reach it. Of the sample's features those take part that are told by a test of independence from the label. Scoring has no bounds.

Defined results: a null or empty text has no sentence and scores as one empty sentence;
repeated rows are scored each; a label that is null is not learnt from, and with no labels
of both kinds every score is the share of label 1 (0.5 without labels); a null id is
not held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import bound_batches, schema_of, with_row_key

SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 48 << 20
#: Training steps and their size, and the weights' penalty over the root of the sample's size.
STEPS, RATE, L1 = 300, 0.05, 3e-3
#: Bytes of the word beginnings that are features; deviations from independence that a feature needs; label 1 weighs (zeros / ones) ** BALANCE.
PREFIXES, SCREEN, BALANCE = (3, 4, 5, 6, 8), 4.0, 0.5
#: Of the sampled documents, the share that has no more sentences than a window.
WINDOW = 0.95

_SEP, _TABLE = kernel.separators("alnum"), kernel.byte_table(fold=True)
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # newline, exclamation mark, full stop, question mark


@dataclass
class Model:
    terms: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float
    constant: float | None = None  # every document's score, where nothing could be learnt
    window: int = 1  # sentences that are scored together

    def weight_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(len(h))
        k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[k] == h, self.weights[k], 0.0)


@dataclass
class Bags:
    """Sentences of many documents; a feature counts once in a sentence."""

    words: np.ndarray  # hash of each distinct feature of each sentence
    sentence: np.ndarray  # its sentence
    doc: np.ndarray  # of each sentence; each document has one at least
    spans: np.ndarray  # (start, end) byte of each sentence in its text
    n_docs: int


def bags(buf: np.ndarray, bounds: np.ndarray) -> Bags:
    starts, ends, first = kernel.word_spans(buf, bounds, _SEP)
    hashed = kernel.span_hashes(buf, starts, ends, _TABLE, PREFIXES)
    stops = np.flatnonzero(_STOP[buf])
    n = len(bounds) - 1
    # A sentence runs to a stop or the text's end; cut[i] is the first byte after sentence i.
    cuts = np.unique(np.concatenate([stops + 1, bounds[1:]])) if len(buf) else np.zeros(0, np.int64)
    of_word = np.searchsorted(cuts, starts, "right")
    used, of_word = np.unique(of_word, return_inverse=True)
    doc = np.searchsorted(bounds, starts, "right") - 1
    doc_of = np.zeros(len(used), np.int64)
    doc_of[of_word] = doc
    begin = np.where(used > 0, cuts[used - 1], 0) if len(used) else np.zeros(0, np.int64)
    spans = np.stack([np.maximum(begin, bounds[doc_of]) - bounds[doc_of], (cuts[used] if len(used) else begin) - bounds[doc_of]], axis=1)
    bare = np.setdiff1d(np.arange(n), doc_of)  # texts without words: one empty sentence each
    h = np.concatenate([hashed[0], *(x ^ np.uint64(1) for x in hashed[1:])])
    of_word = np.concatenate([of_word, *(of_word[ends - starts > length] for length in PREFIXES)])
    order = np.lexsort((h, of_word))
    h, of_word = h[order], of_word[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of_word[1:] != of_word[:-1])) if len(h) else np.zeros(0, bool)
    return Bags(h[new], of_word[new], np.concatenate([doc_of, bare]), np.concatenate([spans, np.zeros((len(bare), 2), np.int64)]), n)


def bags_of(texts: pa.Array) -> Iterator[tuple[int, Bags, int]]:
    """(first text, bags, byte at which they begin in it) of runs of texts; a long text comes in pieces that end after a sentence, so memory does not grow with it."""
    for row, buf, bounds in kernel.chunks(texts):
        if len(buf) <= 2 * kernel.CHUNK or _SEP[buf].all():
            yield row, bags(buf, bounds), 0
            continue
        stops = np.flatnonzero(_STOP[buf]) + 1
        at = stops[np.minimum(np.searchsorted(stops, np.arange(kernel.CHUNK, len(buf), kernel.CHUNK)), max(0, len(stops) - 1))] if len(stops) else stops
        edges = np.unique(np.concatenate([[0], at, [len(buf)]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if not _SEP[buf[a:b]].all():
                yield row, bags(buf[a:b], np.array([0, b - a])), a


def sentence_logits(b: Bags, model: Model) -> np.ndarray:
    return model.bias + np.bincount(b.sentence, model.weight_of(b.words), len(b.doc))


def noisy_or(doc: np.ndarray, n_docs: int, logits: np.ndarray, window: int) -> np.ndarray:
    """1 - prod(1 - p) of the sentences of each document's highest window, by sums of log(1 - p)."""
    order = np.argsort(doc, kind="stable")
    doc, parts = doc[order], np.logaddexp(0, logits)[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    best = np.zeros(n_docs)
    for shift in (0, window // 2):
        k = (place + shift) // window
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]))[: len(doc)])
        if len(first):
            np.maximum.at(best, doc[first], np.add.reduceat(parts, first))
    return -np.expm1(-best)


def _merged(seen: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counted features (hash, documents, documents of label 1), added up."""
    terms, place = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
    counted, ones = (np.bincount(place, np.concatenate([x[k] for x in seen]), len(terms)) for k in (1, 2))
    return terms, counted, ones


def screened(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """The features whose number of documents of label 1 is SCREEN deviations off what their number of documents gives, sorted."""
    seen, n_docs = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))], len(y)
    for row, b, _ in bags_of(texts):
        own = b.doc[b.sentence]
        order = np.lexsort((own, b.words))
        h, own = b.words[order], own[order]
        once = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))[: len(h)]  # a feature counts once in a document
        found, at = np.unique(h[once], return_inverse=True)
        seen.append((found, np.bincount(at, minlength=len(found)), np.bincount(at, y[own[once] + row], len(found))))
        if len(seen) > 4:
            seen = [_merged(seen)]
    terms, docs_with, ones_with = _merged(seen)
    share = float(y.mean())
    spread = np.sqrt(docs_with * share * (1 - share) * np.maximum(1 - docs_with / n_docs, 1e-9))
    return terms[np.abs(ones_with - docs_with * share) >= SCREEN * spread]


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Adam on the documents' log likelihood under the noisy-or, with soft thresholding of the weights."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0, share)
    y = labels.astype(float)
    terms = screened(texts, y)
    blocks, n_docs = [], len(y)  # of a chunk of text each: the known features, their sentences and the sentences' documents
    for row, b, _ in bags_of(texts):
        k = np.minimum(np.searchsorted(terms, b.words), max(0, len(terms) - 1))
        known = terms[k] == b.words if len(terms) else np.zeros(len(b.words), bool)
        blocks.append((k[known].astype(np.int32), b.sentence[known].astype(np.int32), (b.doc + row).astype(np.int32)))
    per_doc = np.zeros(n_docs, np.int64)
    for _, _, doc in blocks:
        per_doc += np.bincount(doc, minlength=n_docs)
    w = np.zeros(len(terms) + 1)
    w[-1] = np.log(share / max(1.0, float(np.median(per_doc))))  # a sentence is seldom the offending one
    m, v = np.zeros_like(w), np.zeros_like(w)
    penalty, ones_weight = L1 / np.sqrt(n_docs), ((1 - share) / share) ** BALANCE
    for step in range(1, STEPS + 1):
        logits = [w[-1] + np.bincount(sentence, w[word], len(doc)) for word, sentence, doc in blocks]
        total = np.zeros(n_docs)
        for z, (_, _, doc) in zip(logits, blocks, strict=True):
            total += np.bincount(doc, np.logaddexp(0, z), n_docs)
        clear = np.clip(np.exp(-total), 1e-9, 1 - 1e-9)  # prod(1 - p)
        slope = np.where(y > 0, -ones_weight * clear / (1 - clear), 1.0) / n_docs
        g = np.zeros_like(w)
        for z, (word, sentence, doc) in zip(logits, blocks, strict=True):
            pull = slope[doc] / (1 + np.exp(-np.clip(z, -30, 30)))
            g[:-1] += np.bincount(word, pull[sentence], len(terms))
            g[-1] += pull.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        size = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= size * (m / (1 - 0.9**step))
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - np.minimum(size[:-1] * penalty, RATE))  # few words matter
    return Model(terms, w[:-1], float(w[-1]), window=max(1, int(np.quantile(per_doc, WINDOW))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the bounded sample of labelled rows; labels must hold no held-out rows."""
    wanted = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
    sample = wanted.orderBy(F.xxhash64("_id"), "_id", "_y").limit(SAMPLE_ROWS)
    bound_batches(docs.sparkSession)
    keyed = with_row_key(docs).select(F.col("_doc").getField(id_col).alias("_id"), F.col("_doc").getField(text).alias("text"), "_file", "_row")
    met = keyed.select("_id", "_file", "_row", F.octet_length("text").alias("size")).join(F.broadcast(sample), "_id")  # SAMPLE_ROWS small rows
    chosen, size = [], 0
    for r in met.orderBy(F.xxhash64("_id"), "_id", "_file", "_row", "_y").limit(SAMPLE_ROWS).select("_file", "_row", "_y", "size").collect():
        size += r["size"] or 0
        if chosen and size > SAMPLE_BYTES:
            break
        chosen.append((r._file, r._row, r._y, len(chosen)))
    if not chosen:
        return fit(pa.array([], pa.string()), np.zeros(0))
    picked = docs.sparkSession.createDataFrame(chosen, "_file long, _row long, _y int, place int")  # SAMPLE_ROWS at most
    ordered = keyed.join(F.broadcast(picked), ["_file", "_row"]).select("text", "_y", "place").repartition(1).sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("_y", pa.int32()), ("place", pa.int32())]))
        model = fit(table.column(0).combine_chunks(), table.column(1).to_numpy() > 0)
        constant = pa.array([model.constant], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([model.terms.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias]), constant, pa.array([model.window], pa.int64())], names=["terms", "weights", "bias", "constant", "size"])

    # The sample is one partition, so one task fits the model and the driver only gets that.
    made = ordered.mapInArrow(kernel.freeing(run), "terms binary, weights binary, bias double, constant double, size bigint").collect()
    return Model(np.frombuffer(made[0].terms, np.uint64), np.frombuffer(made[0].weights, np.float64), made[0].bias, made[0].constant, made[0]["size"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, score (0 to 1), with the columns named in carry (the text may be one)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # no more features than SAMPLE_BYTES gives
    keep = list(dict.fromkeys(c for c in (id_col, *carry) if c.lower() != "score"))
    schema = schema_of([docs.schema[c] for c in keep], "score double")
    sent = keep if text in keep else [*keep, text]
    at = sent.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value.constant is None:
                doc, logits = [np.zeros(0, np.int64)], [np.zeros(0)]
                for row, b, _ in bags_of(batch.column(at)):
                    doc.append(b.doc + row)
                    logits.append(sentence_logits(b, shared.value))
                found = noisy_or(np.concatenate(doc), batch.num_rows, np.concatenate(logits), shared.value.window)
            else:
                found = np.full(batch.num_rows, shared.value.constant)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], names=[*keep, "score"])

    return docs.select(*sent).mapInArrow(kernel.freeing(run), schema)


def locate(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The sentences of a probability of at least `least`: id, start, end (bytes of the UTF-8 text), sentence, probability."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for row, b, start in bags_of(batch.column(1)):
                p = 1 / (1 + np.exp(-np.clip(sentence_logits(b, shared.value), -30, 30)))
                for s in np.flatnonzero(p >= least):
                    d, x, y = row + int(b.doc[s]), start + int(b.spans[s][0]), start + int(b.spans[s][1])
                    whole = (batch.column(1)[d].as_py() or "").encode("utf-8")[x:y].decode("utf-8", "replace")
                    out.append((ids[d].as_py(), x, y, whole, float(p[s])))
            out.sort(key=lambda r: (str(r[0]), r[1]))
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[id_col, "start", "end", "sentence", "probability"])

    return docs.select(id_col, text).mapInArrow(kernel.freeing(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start bigint, `end` bigint, sentence string, probability double")


def held_out(id_col: str = "doc_id"):
    """Whether an id belongs to the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, by a model of the labels that are not held out."""
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score under `least`, with all their columns as they are, by a model of the labels that are not held out."""
    model = train(docs, labels.where(~held_out(id_col)), id_col, text)
    packed = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("rest"))
    kept = score(packed, model, "rest", carry=("text",)).where(F.col("score") < least)
    return kept.select(*(F.col("text").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns))
