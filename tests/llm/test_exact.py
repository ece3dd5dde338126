"""Operators against slow versions of themselves, exact offsets, clashing names, and the isolation of the subpackage."""

import collections
import math
import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import decontaminate, jaccard, kernel, linededup, packing, prefixcount, quality, registry, toxicity, urlrules

SF = "/root/testdata/sf0.001"
CLASHES = "doc_id long, text string, _file long, _row string, _doc int, _key string, lost int, score double, predicted int, held_out string, rest int, N_removed int, n_shingles int, component_root int, n_chars int"


def clashing(stored):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"first {passage}", f"second text\n{passage} end", "third text has words of its own, more than five", "third text has words of its own, more than five", None, ""]
    return stored([(i % 5, t, 1000 + i, f"r{i}", i, "mine", i, 7.0, 8, "nine", 3, 4, 5, 6, len(t or "")) for i, t in enumerate(texts)], CLASHES)


def own(row, names):
    return tuple(row[c] for c in names)


def test_clashing_names(stored):
    docs = clashing(stored)
    before = {r._file: r for r in docs.collect()}
    rest = [c for c in docs.columns if c != "text"]
    items = stored([(1, "first p0 p1 p2")], "item_id long, text string", "benchmark")
    kept = decontaminate.clean(docs, items).collect()
    assert {r._file for r in kept} == set(before) - {1000} and all(r == before[r._file] for r in kept)
    found = linededup.dedup(docs)
    assert found.columns == [c for c in docs.columns if c != "N_removed"] + ["removed", "n_removed"]
    names = [c for c in rest if c != "N_removed"]
    assert all(own(r, names) == own(before[r._file], names) for r in found.collect()) and found.count() == 6
    one = jaccard.one_of_each(docs).collect()
    assert len(one) == 4 and all(r == before[r._file] for r in one)
    linked = jaccard.link_components(docs, carry=("_file", "_row", "n_shingles", "lost"))
    assert linked.columns == ["doc_id", "_file", "_row", "lost", "n_shingles", "component_id"]
    assert all((r._row, r.lost) == (before[r._file]._row, before[r._file].lost) for r in linked.collect())
    labels = stored([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int", "labels")
    clean = toxicity.drop_toxic(docs, labels, 2.0).collect()
    assert len(clean) == 6 and all(r == before[r._file] for r in clean)


def test_pipeline_stages_with_awkward_rows(spark, stored, tmp_path, nothing):
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    for docs in (clashing(stored), nothing):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns
            rows = out.collect()
            assert len(rows) <= docs.count()
            if name in ("toxicity", "benchmark_decontamination", "ngram_jaccard_join") and "_file" in docs.columns:
                before = {r._file: r for r in docs.collect()}
                assert all(r == before[r._file] for r in rows)
            if name in ("substring_dedup", "bpe_encoding"):
                assert len(rows) == docs.count()


def slow_dedup(rows):
    """Repeated whole lines, and runs of words that an earlier document has; rows are (id, text), ids whole numbers and told apart."""
    norm = lambda x: " ".join(x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split())
    seen, out = set(), {}
    for i, text in sorted(rows):
        out[i] = []
        for line in text.split("\n"):
            n = norm(line)
            if n and n not in seen:
                seen.add(n)
                out[i].append(n)
    return out


def test_lines_equal_brute_force(stored):
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    rows = []
    for i in range(200):
        rows.append((i, "\n".join(rng.choice(("", "  ")) + rng.choice((str.upper, str.lower, str))(rng.choice(lines)) for _ in range(rng.randrange(8)))))
    want = slow_dedup(rows)
    texts = dict(rows)
    for r in linededup.dedup(stored(rows, "doc_id long, text string")).collect():
        assert [" ".join(x.lower().split()) for x in r.text.split("\n") if x.strip()] == want[r.doc_id]
        left, at = "", 0
        for a, b in r.removed:
            left, at = left + texts[r.doc_id][at:a], b
        assert left + texts[r.doc_id][at:] == r.text


def test_nothing_is_lost_without_an_offset(stored):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, f"head line  \n\n \t{passage}"), (3, f"a b\n{passage}  \n \n"), (4, "said said said said said said said said said said said said said said said said said said said said said said said")]
    got = {r.doc_id: r for r in linededup.dedup(stored(rows, "doc_id long, text string")).collect()}
    assert got[2].text == "head line" and [tuple(x) for x in got[2].removed] == [(9, len(rows[1][1]))]
    assert got[3].text == "a b" and got[3].removed[0].start == 3
    assert got[4].n_removed == 0  # a line that says a word over and over repeats nothing of another document


def test_ids_of_any_type_rank(stored):
    line = "the very same line in all of them"
    rows = [(f"doc-{i:03}", f"own words number {i}\n{line}") for i in (30, 7, 12, 3, 25)] + [(None, line)]
    got = {r.doc_id: r.n_removed for r in linededup.dedup(stored(rows, "doc_id string, text string")).collect()}
    assert got == {"doc-003": 0, "doc-007": 1, "doc-012": 1, "doc-025": 1, "doc-030": 1, None: 1}


def test_noisy_or_equals_brute_force(stored):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "dreadful", "delta", "longerword"]
    rows = [(i, ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    docs = stored(rows, "doc_id long, text string")
    model = toxicity.train(docs, stored([(i, int("dreadful" in t)) for i, t in rows], "doc_id long, toxic int", "labels"))
    assert len(model.terms)

    def features(sentence):
        for w in sentence.encode().split():
            yield w, 0
            for n in toxicity.PREFIXES:
                if len(w) > n:
                    yield w[:n], 1

    def weight(token, beginning):
        buf = np.frombuffer(token, np.uint8)
        h = kernel.word_hashes(buf, np.array([0]), np.array([len(buf)]), kernel.byte_table(fold=True)) ^ np.uint64(beginning)
        return float(model.weight_of(h)[0])

    model.window = 100
    for r in toxicity.score(docs, model).collect():
        clear = 1.0
        for sentence in dict(rows)[r.doc_id].split("."):
            z = model.bias + sum(weight(*f) for f in set(features(sentence)))
            clear *= 1 - 1 / (1 + math.exp(-z))
        assert abs(r.score - (1 - clear)) < 1e-9


def test_hosts_that_differ_change_rows(stored):
    """A host that fails far more often than the others loses its good documents; the tables' own hosts fail alike, and none is rejected."""
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    bad = [(10_000 + i, "too short" if i % 5 else rows[0][1] + f" number {i}", "bad.example") for i in range(100)]
    docs = stored(rows + bad, "doc_id long, text string, source string")
    changed = [r.doc_id for r in quality.quality(docs).collect() if r.kept == r.base_failed]
    assert changed and all(i >= 10_000 for i in changed)


def test_thousands_of_rules(spark, stored):
    rng = random.Random(6)
    parts = ["ads", "track", "shop", "news", "img", "banner", "cdn", "pop", "aff", "go"]
    lines = {rng.choice(("", "@@")) + rng.choice(("", "|", "||")) + rng.choice(("", "*")) + rng.choice(parts) + str(rng.randrange(300)) + rng.choice((".", "/", "^", "*", "-")) + rng.choice(parts) + rng.choice(("", "^", "*x", "|")) for _ in range(3000)}
    urls = [f"http://{rng.choice(parts)}{rng.randrange(300)}{rng.choice('.-')}{rng.choice(parts)}.com/{rng.choice(parts)}{rng.randrange(300)}/{rng.choice(parts)}" for _ in range(400)]
    rules = urlrules.parse_rules(stored([(x,) for x in lines] + [(None,), ("",)], "pattern string", "rules"))
    assert rules.count() == len(lines)
    table = [urlrules.parse_rule(x) for x in lines]
    want = {}
    for i, u in enumerate(urls):
        fit = [r for r in table if re.search(r.regex, u[7:])]
        want[i] = min(fit, key=lambda r: (-len(r.name), r.name)) if fit else None
    assert 20 < sum(x is not None for x in want.values()) < 400
    pages = stored(list(enumerate(urls)), "page_id long, url string", "pages")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.filter_urls(pages, rules, ()).collect()}
    assert got == {i: (r.name, r.verdict) if r else (None, "allow") for i, r in want.items()}


def slow_packing(rows, shards):
    """Largest group first, each to the shard of the highest dot product with what its capacity has left."""
    tokens = lambda t: len(t) - len(t.replace(" ", "").replace("\n", "")) + 1
    vectors = {t: np.array([len(t.encode()) + 8, tokens(t), 1.0]) for _, t in rows}
    total = sum(vectors.values())
    left = [np.array([400.0, 1.0, 1.0]) * total / shards / total for _ in range(shards)]
    home = {}
    for t in sorted(vectors, key=lambda t: -vectors[t][0]):
        unit = vectors[t] / total
        home[t] = max(range(shards), key=lambda s: float(left[s] @ unit))
        left[home[t]] = left[home[t]] - np.array([400.0, 1.0, 1.0]) * unit
    return home


def test_packing_equals_brute_force(stored, monkeypatch):
    monkeypatch.setattr(packing, "LARGE_SHARE", 1e9)  # one bucket, no group placed before the others
    rng = random.Random(8)
    rows = [(i, "x" * (100 + 3 * i) + " y" * rng.randrange(20)) for i in range(150)]
    sizes = collections.Counter(len(t) for _, t in rows)
    rows = [(i, t) for i, t in rows if sizes[len(t)] == 1]
    want = slow_packing(rows, 4)
    got = {r.doc_id: r.shard for r in packing.assign(stored(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: want[t] for i, t in rows}


def test_shards_on_disk(spark, stored, tmp_path):
    docs = stored([(1, "a b"), (1, "c"), (2, "a b"), (None, None), (3, "")], "doc_id long, text string")
    packing.write_shards(docs, f"{tmp_path}/shards", 2)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted((r.doc.doc_id or 0, r.doc.text or "") for r in back) == [(0, ""), (1, "a b"), (1, "c"), (2, "a b"), (3, "")]
    for s in {r.shard for r in back}:
        assert sorted(r.slot for r in back if r.shard == s) == list(range(sum(r.shard == s for r in back)))


def test_every_prefix_equals_the_library(spark, stored):
    library = Tokenizer.from_file(registry.COUNT_TOKENIZER)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(9)
    texts = ["日本語の文字列です漢字", "internationalization don't we'Re x're ''s", "Hello,World...Foo 12ab!!'s", "  spaced  out \n text ", "naïveté ß e\u0301x ab<|endoftext|>cd"]
    texts += ["".join(rng.choice("abcdeé日'!1sтlr ") for _ in range(rng.randrange(1, 40))) for _ in range(100)]
    docs = stored(list(enumerate(texts)), "doc_id long, text string")
    for r in prefixcount.prefix_counts(docs, registry.COUNT_TOKENIZER).collect():
        whole = texts[r.doc_id].encode()
        assert all(n(whole[:b].decode()) == k for b, k in zip(r.prefix_bytes, r.prefix_tokens))
        if "<|" not in texts[r.doc_id] and "\u0301" not in texts[r.doc_id]:
            assert len(r.prefix_bytes) == sum(not c.isspace() for c in texts[r.doc_id])
    long = stored([(1, "日本語の文字列です漢字情報" * 1000), (2, "a b " + "x" * 10_000)], "doc_id long, text string", "long")
    rows = {r.doc_id: r for r in long.collect()}
    for r in prefixcount.count_tokens(long, registry.COUNT_TOKENIZER, limit=100).collect():
        whole = rows[r.doc_id].text.encode()
        assert r.over_limit and r.cut_bytes > 100 and n(whole[: r.cut_bytes].decode()) <= 100
        end = r.cut_bytes + len(whole[r.cut_bytes :].decode()[0].encode())
        assert n(whole[:end].decode()) > 100
    table = prefixcount.fits(prefixcount.prefix_counts(long, registry.COUNT_TOKENIZER), 100).select("doc_id", "cut_bytes")
    assert {tuple(x) for x in table.collect()} == {(r.doc_id, r.cut_bytes) for r in prefixcount.count_tokens(long, registry.COUNT_TOKENIZER, limit=100).collect()}


def test_tokenizers_that_join_white_space_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError, match="add up"):
        prefixcount.ChunkCounts(f.read())


def test_chat_mask_of_another_string(spark):
    from tidelog.llm import chat

    runs = "array(named_struct('n_chars', 3L, 'in_loss', false), named_struct('n_chars', 9L, 'in_loss', true), named_struct('n_chars', 4L, 'in_loss', false))"
    df = spark.sql(f"SELECT '<s>[INST]assistant[/INST]ok</s>' AS f, {runs} AS r")
    with pytest.raises(Exception, match="loss mask"):
        df.select(chat.loss_text(F.col("f"), F.col("r"))).collect()


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / f, tmp_path / f)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mvcc_latest' in q and 'pipeline' not in q and not any(x.startswith('op1_') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    (tmp_path / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
