"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, per operator."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, decontaminate, graph, jaccard, kernel, linededup, packing, prefixcount, quality, registry, toxicity, urlrules


def item_table(stored, rows):
    return stored(rows, "item_id long, text string", "benchmark")


def test_decontamination(awkward, nothing, stored):
    items = item_table(stored, [(1, "two THREE, four"), (2, None), (3, "..."), (None, "one two"), (1, "two three four"), (4, " ".join(f"word{i % 997}" for i in range(20)))])
    got = decontaminate.judge(awkward, items).collect()
    assert len(got) == 10
    ones = [r for r in got if r.doc_id == 1 and r.n_words == 7]
    assert [(r.n_hit, r["items"], r.contaminated) for r in ones] == [(3, ["1"], True)] * 2
    assert all(r.n_hit == 0 and not r.contaminated for r in got if r.doc_id in (2, 3, 4, 6, None))
    assert next(r for r in got if r.doc_id == 5).n_items == 1
    assert decontaminate.judge(nothing, items).count() == 0
    none = decontaminate.judge(awkward, item_table(stored, [])).collect()
    assert len(none) == 10 and not any(r.n_hit for r in none)
    kept = decontaminate.clean(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == 8


def test_decontamination_in_blocks_is_the_same(awkward, stored, monkeypatch):
    items = item_table(stored, [(i, " ".join(f"word{(i + k) % 997}" for k in range(15))) for i in range(30)])
    whole = sorted(map(str, decontaminate.judge(awkward, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1000)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 100)
    assert sorted(map(str, decontaminate.judge(awkward, items).collect())) == whole


def test_phrase_and_proximity(stored):
    docs = stored([(1, "the red fox and the red hen"), (2, "red hen far away from the very old fox")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    got = sorted((r.doc_id, r.item, r.start, r.end) for r in decontaminate.phrase_matches(index, [("a", "the red"), ("b", "RED hen")]).collect())
    assert got == [("1", "a", 0, 2), ("1", "a", 4, 6), ("1", "b", 5, 7), ("2", "b", 0, 2)]
    near = lambda slop: sorted((r.doc_id, r.start, r.end) for r in decontaminate.proximity_matches(index, "fox hen", slop).collect())
    assert near(5) == [("1", 2, 7)]
    assert near(9) == [("1", 2, 7), ("2", 1, 9)]


def test_quality(awkward, nothing):
    got = quality.quality(awkward).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[6].n_words == 1 and by[6].word_chars == 100_000
    assert by[5].n_words == 60_000 and by[5].n_repeat_words == 60_000
    assert quality.quality(nothing).count() == 0


def test_host_verdicts_shrink(stored):
    rows = [(i, "short" if i % 10 else " ".join(f"w{k}" for k in range(60)), "bad") for i in range(100)] + [(1000 + i, " ".join(f"v{k}" for k in range(60)), f"h{i % 30}") for i in range(90)] + [(5000, "short", "h0")]
    docs = stored(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not any(kept[i] for i in range(100))  # good texts of a bad host go, too
    assert all(kept[1000 + i] for i in range(90))  # one failure does not reject a small host


def test_urls(stored):
    rows = [(1, "http://a.example.com/en/x"), (2, None), (3, "nonsense"), (4, "https://WWW.Example.com/en/?q"), (5, "http://x.net/es/1"), (5, "http://x.net/es/1"), (6, "http://free-casino.org/"), (7, "http://notexample.com/en/"), (None, "http://com"), (8, "http://x.net/" + "es/" * 20_000)]
    pages = stored([(a, b, "h") for a, b in rows], "page_id long, url string, rule string", "pages")
    got = urlrules.filter_urls(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    assert by == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("www.example.com/en/", "allow"), 5: ("net/es/", "block"), 6: (None, "block"), 7: ("com/", "allow"), None: (None, "allow"), 8: ("net/es/", "block")}
    assert urlrules.filter_urls(pages.where("false")).count() == 0


def test_urls_by_shuffle_are_the_same(stored, monkeypatch):
    pages = stored([(i, f"http://h{i}.example.{'com' if i % 2 else 'net'}/{'en' if i % 3 else 'fr'}/{i}") for i in range(200)], "page_id long, url string", "pages")
    whole = sorted(map(str, urlrules.filter_urls(pages).collect()))
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 0)
    assert sorted(map(str, urlrules.filter_urls(pages).collect())) == whole


def test_toxicity(awkward, nothing, stored):
    labels = stored([(1, 1), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int", "labels")
    model = toxicity.train(awkward, labels)
    got = toxicity.score(awkward, model, carry=("text", "score", "shard")).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(nothing, model).count() == 0
    unlabelled = toxicity.score_held_out(awkward, labels.where("false")).collect()
    assert len(unlabelled) == 10 and {r.score for r in unlabelled} == {0.5}


def test_toxicity_finds_the_sentence(stored):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(8)) for _ in range(rng.randrange(2, 9))]
        if bad:
            sentences[rng.randrange(len(sentences))] += " dreadful"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    docs = stored(rows, "doc_id long, text string")
    model = toxicity.train(docs, stored(labels, "doc_id long, toxic int", "labels"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((score[i] >= 0.5) == bool(y) for i, y in labels)
    found = toxicity.locate(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i, y in labels if y}
    texts = dict(rows)
    assert all(texts[r.doc_id].encode()[r.start : r.end].decode() == r.sentence for r in found)
    assert sum("dreadful" in r.sentence for r in found) > 0.95 * len(found)


def test_toxicity_of_very_long_texts(stored):
    from compare import connect

    sf = "/root/testdata/sf0.1"
    rows = connect(sf).execute("SELECT doc_id, text, toxic FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    docs = stored([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, stored([(i, y) for i, _, y in rows], "doc_id long, toxic int", "labels").where(~toxicity.held_out()))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).where(toxicity.held_out()).collect()}
    clean = [t for i, t, y in rows if i in score and not y and score[i] < 0.5]
    bad = next(t for i, t, y in rows if y and score.get(i, 0) > 0.9)
    long = [(1, "\n".join(clean)), (2, "\n".join(clean * 5)), (3, "\n".join([*clean, bad, *clean]))]
    assert len(long[0][1]) > 1_000_000
    got = {r.doc_id: r.score for r in toxicity.score(stored(long, "doc_id long, text string"), model).collect()}
    assert got[1] < 0.5 and got[2] < 0.5 and got[3] > 0.9


def test_substring_dedup(awkward, nothing):
    got = linededup.dedup(awkward).collect()
    assert len(got) == 10 and set(awkward.columns) <= set(got[0].asDict())
    assert next(r for r in got if r.doc_id == 2).text is None
    assert linededup.dedup(nothing).count() == 0


def test_substring_dedup_keeps_the_earliest(stored):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(3, f"start three {passage} end three"), (1, f"One {passage.upper()}"), (2, f"two lines\n{passage}\nlast line"), (4, "nothing in common here"), (2, passage)]
    by = {}
    for r in linededup.dedup(stored(rows, "doc_id long, text string")).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and by[4][0].n_removed == 0
    for r in [*by[2], *by[3]]:
        assert r.n_removed == 1
        words = r.text.split()
        assert sum(w.startswith("p") and w[1:].isdigit() for w in words) <= 20
    assert by[3][0].text.startswith("start three") and by[3][0].text.endswith("end three")
    assert "two lines" in by[2][0].text + by[2][1].text


def test_substring_dedup_removes_short_lines(stored):
    line = "All rights reserved by nobody at all, they say."
    rows = [(1, f"first text\n{line}\nits end"), (2, f"second text\n  {line.upper()}\n\nanother end\n{line}"), (3, line), (4, f"inside a line {line} stays"), (5, "}\nfive\n}"), (6, "its second text")]
    got = {r.doc_id: r for r in linededup.dedup(stored(rows, "doc_id long, text string")).collect()}
    assert {i: r.text.split() for i, r in got.items()} == {1: rows[0][1].split(), 2: "second text another end".split(), 3: [], 4: rows[3][1].split(), 5: ["}", "five"], 6: rows[5][1].split()}
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 2, 3: 1, 4: 0, 5: 1, 6: 0}
    assert all(rows[2][1][r.start : r.end] == line for r in got[3].removed)


def test_chat(spark, stored):
    tricky = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\s> \\", "", None, "[NEXT][NEXT]</s", "<s>", "[\\/INST]", "\n日本 [INST]"]
    rows = [(1, i, "user" if i % 3 else "assistant", t, "x") for i, t in enumerate(tricky)] + [(None, 0, None, "no id", "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x"), (2, None, "user", "b", "x"), (3, 1, "user", None, "x")]
    table = stored(rows, "conv_id long, turn long, role string, text string, formatted string", "conversations")
    out = chat.format_conversations(table.drop("formatted"))
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert back[1] == [("user" if i % 3 else "assistant", t or "") for i, t in enumerate(tricky)]
    assert back[None] == [("", "no id")] and back[2] == [("user", "b"), ("assistant", "a"), ("assistant", "a")] and back[3] == [("user", "")]
    loss = {r.conv_id: r.t for r in out.select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_runs")).alias("t")).collect()}
    assert loss[1] == "".join(t or "" for i, t in enumerate(tricky) if not i % 3) and loss[2] == "aa" and loss[3] == ""
    assert chat.digest(chat.format_conversations(table.where("false").drop("formatted"))).count() == 0


def test_packing(spark, awkward, nothing):
    got = packing.assign(awkward, 3).collect()
    assert len(got) == 10
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert packing.assign(nothing, 3).count() == 0


def test_packing_is_even_with_a_hot_group(spark, stored, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 500)
    rng = random.Random(2)
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"{i} " + "y" * rng.randrange(400)) for i in range(6000)]
    sizes, counts = {}, {}
    for r in packing.assign(stored(rows, "doc_id long, text string"), 12).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        counts[r.shard] = counts.get(r.shard, 0) + 1
    assert len(sizes) == 12
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert max(counts.values()) < 1.15 * min(counts.values())


def test_bpe(awkward, nothing):
    got = bpe.encode_digest(awkward, registry.BPE_RANKS)
    assert {"doc_id", "source", "score", "shard"} <= set(got.columns) and got.count() == 10
    assert bpe.encode_digest(nothing, registry.BPE_RANKS).count() == 0
    ids = bpe.encode(awkward, registry.BPE_RANKS)
    back = {r.doc_id: (bytes(r.decoded), r.token_offsets) for r in bpe.decode(ids, registry.BPE_RANKS).where("doc_id in (2, 7)").collect()}
    assert back[2] == (b"", [0]) and back[7][0].decode() == "naïve 日本語 😀 text" and back[7][1][-1] == len(back[7][0])


def test_bpe_boundaries_equal_the_library():
    with open(registry.BPE_RANKS, "rb") as f:
        data = f.read()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab's tldrevm \n\t　é12!'’中 ") for _ in range(rng.randrange(50))) for _ in range(3000)] + ["a" * 3000, " " * 500, "'" * 99]
    for t, ids in zip(texts, bpe.encode_texts([t.encode() for t in texts], data), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::37]
    texts = [f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}" for c in points]
    for t, ids in zip(texts, bpe.encode_texts([t.encode() for t in texts], data), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)


def test_scan_is_associative():
    rng = np.random.default_rng(0)
    functions = bpe._OF_CLASS[rng.integers(0, bpe._CLASSES, 5000)]
    state, want = bpe.CLOSED, []
    for f in functions:
        want.append(state)
        state = bpe._VALUES[f, state]
    assert bpe.states_before(functions).tolist() == want


def test_jaccard(awkward, nothing):
    got = jaccard.link_components(awkward, carry=("source",)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(got) == 10
    assert sorted(by[1]) == [(1, 1), (3, 1), (3, 1)] and by[2] == [(0, 2)] and by[4] == [(0, 4)] and by[6] == [(1, 6)]
    assert jaccard.link_components(nothing).count() == 0
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == 9


@pytest.mark.parametrize(("short", "block", "share"), [(24, 1024, 8), (2, 3, 100), (2, 3, 0)])
def test_jaccard_groups_of_copies(stored, monkeypatch, short, block, share):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SENT_SHARE", share)
    rng = random.Random(7)
    base = [[f"b{k}_{rng.randrange(40)}" for _ in range(80)] for k in range(4)]
    rows = []
    for i in range(120):
        w = list(base[i % 4])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(80)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(76)} for i, t in rows}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    got = jaccard.link_components(stored(rows, "doc_id long, text string")).collect()
    want = {i: (len(s), root[i]) for i, s in sets.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_of_very_long_texts(stored):
    words = [f"v{i}" for i in range(310_000)]
    rows = [(2, " ".join(words)), (1, " ".join(words[:-5000])), (3, " ".join(words[:200_000]))]
    got = jaccard.link_components(stored(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {2: (309_996, 1), 1: (304_996, 1), 3: (199_996, 3)}


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 200), (200, 300), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 200: 100, 300: 100}
    assert graph.components(links.where("false")).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    order = random.Random(3).sample(range(1000, 4000), 3000)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(9000, k) for k in range(500)]
    table = spark.createDataFrame(random.Random(4).sample(links, len(links)), "u long, v long").repartition(16)
    got = {r.node: r.root for r in graph.components(table).collect()}
    assert got == {**{k: 1000 for k in range(1001, 4000)}, **{k: 0 for k in [*range(1, 500), 9000]}}


def test_contracted_links_connect_the_same():
    rng = np.random.default_rng(5)
    for _ in range(200):
        u, v = rng.integers(-30, 30, (2, int(rng.integers(0, 50))))
        root = {x: x for x in [*u.tolist(), *v.tolist()]}
        for _ in root:
            for a, b in zip(u.tolist(), v.tolist()):
                root[a] = root[b] = min(root[a], root[b])
        nodes, roots = graph.contract(u, v)
        assert dict(zip(nodes.tolist(), roots.tolist())) == {x: r for x, r in root.items() if x != r}


def test_members_that_share_a_list():
    rng = random.Random(6)
    lists = [[rng.randrange(-4000, 4000) for _ in range(rng.randrange(1, 60))] for _ in range(90)]
    assert jaccard._shared(lists).tolist() == [[not set(a).isdisjoint(b) for b in lists] for a in lists]


def test_prefix_counts(awkward, nothing):
    path = registry.COUNT_TOKENIZER
    got = prefixcount.count_tokens(awkward, path, limit=10).collect()
    assert len(got) == 10
    assert [(r.n_bytes, r.n_tokens) for r in got if r.doc_id in (2, 3)] == [(0, 0), (0, 0)]
    assert prefixcount.count_tokens(nothing, path).count() == 0
    table = prefixcount.fits(prefixcount.prefix_counts(awkward, path), 5)
    for r in table.join(awkward.select("doc_id", "text"), "doc_id").where("doc_id = 5").collect():
        head = r.text.encode()[: r.cut_bytes].decode()
        again = next(iter(prefixcount.prefix_table(*kernel.text_buffers(pa.array([head])), open(path, "rb").read())))[2]
        assert r.cut_tokens <= 5 and int(again[-1]) == r.cut_tokens
