"""Contract queries against SQL and brute force, on the smallest tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from compare import check, connect
from tokenizers import Tokenizer

from tidelog.llm import bpe, registry

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    check(registry.QUERIES[name](spark, SF), con, registry.SQL[name])


def test_op4_held_out_accuracy(spark, con):
    """On the larger table: the fold is right, and held-out documents are ranked well."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in registry.op4_toxicity(spark, sf).collect()}
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    labels = connect(sf).execute("SELECT doc_id, toxic FROM labels").fetchall()
    held = sorted((got[d].score, y) for d, y in labels if got[d].held_out)
    ones = sum(y for _, y in held)
    auc = (sum(i for i, (_, y) in enumerate(held) if y) - ones * (ones - 1) / 2) / (ones * (len(held) - ones))
    assert auc > 0.9
    flagged = [y for s, y in held if s >= 0.5]
    assert sum(flagged) / len(flagged) > 0.9


def test_op7_shards(spark, con, texts):
    rows = registry.op7_sharding(spark, SF).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r.doc_id for r in rows) == sorted(texts)


def test_op8_equals_the_library(spark, texts):
    with open(registry.BPE_RANKS, "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    for r in registry.op8_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def test_op9_equals_brute_force(spark, texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    want = components(sets)
    got = registry.op9_jaccard(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()}


def test_op10_equals_the_library(spark, texts):
    library = Tokenizer.from_file(registry.COUNT_TOKENIZER)
    for r in registry.op10_tokens(spark, SF).collect():
        t = texts[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)


def test_op5_leaves_one_of_each_passage(spark, texts):
    def grams(t, k=50):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    first, repeated = {}, set()
    for d in sorted(texts):
        for g in grams(texts[d]):
            if first.setdefault(g, d) != d:
                repeated.add(g)
    assert repeated
    for r in registry.op5_linededup(spark, SF).collect():
        assert not any(g in repeated and first[g] != r.doc_id for g in grams(r.text))
        assert r.n_removed == len(r.removed)
        if not r.removed:
            assert r.text == texts[r.doc_id]
        left, at = "", 0
        for s, e in r.removed:
            left, at = left + texts[r.doc_id][at:s], e
        assert left + texts[r.doc_id][at:] == r.text


def test_pipeline_stages(spark, tmp_path, texts):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(c.STAGES) - 1:
            assert docs.columns == names
        kept[name] = docs.count()
        assert kept[name] <= before.count()
    sets = {r.doc_id: shingles(r.text) for r in spark.read.parquet(f"{tmp_path}/0").collect()}
    want = components(sets)
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/1").collect()} == {d for d in sets if want[d] == d}
    dirty = {r.doc_id for r in registry.decontaminate.judge(spark.read.parquet(f"{tmp_path}/2"), spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").collect()} == {r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").collect()} - dirty
    whole = {r.doc_id: r.ids_sha256 for r in c.run(spark, SF).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in docs.collect()}
