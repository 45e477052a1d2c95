"""Corpus operators on small cases: brute force, round trips, nulls, empty tables, ties, repeats and clashing columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meshlake.llm import jaccard, licenses, mixing, pieces, quality, queries, sharding, suffixes, tokencode, tokenfile, toolcalls, topk
from meshlake.llm.common import mixed, shared_path, stored, windows_hash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from meshlake.session import local_session

    s = local_session(4, shuffle_partitions=4, memory="6g")
    if not s.conf.get("spark.checkpoint.dir", None):
        pytest.skip("spark.checkpoint.dir is not set")
    return s


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, near copies, extra and clashing columns."""
    rng = random.Random(5)
    base = words(rng, 300)
    near = base.split()
    near[7] = "changed"
    rows = [(1, base, "en", "b", 3), (2, base, "en", "b", 3), (3, " ".join(near), "en", "a", 4), (4, None, None, None, None), (5, "", "en", "a", 0),
            (6, " \t\n\x0b\x0c\r ", "en", "a", 7), (7, words(rng, 20000, 4000), "en", "c", 9), (8, "one two three", "de", None, 2), (8, "one two three", "de", None, 2),
            (9, "One Two THREE", "de", "é", 2), (10, "x " * 500, "en", "a", 1), (11, words(rng, 80) + " " + base[:1200] + " " + words(rng, 70), "en", "\U00010000", 1),
            (12, "Ä ß \U0001f600 é\n" * 40, "fr", "￿", 5), (13, words(rng, 200), "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("clash"), "key": F.lit(1), "words": F.lit(None).cast("int"), "n": F.lit(0)})


def split(text):
    return (text or "").encode().split()


# general helpers


def test_windows_hash_is_a_polynomial_of_every_length():
    h = mixed(np.arange(60, dtype=np.uint64))
    for k in (1, 2, 3, 7, 26, 50, 60):
        acc = [0] * (60 - k + 1)
        for i in range(k):
            acc = [(a * 0x9E3779B97F4A7C15 + int(h[i + j])) % 2**64 for j, a in enumerate(acc)]
        assert (mixed(np.array(acc, dtype=np.uint64)) == windows_hash(h, k)).all()


# 1 n-gram Jaccard join


def brute_links(rows, k, num, den):
    def grams(t):
        w = split((t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


def got_links(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize(("k", "num", "block_rows", "leaf"), [(4, 85, 2048, 512), (5, 80, 7, 512), (3, 50, 40, 16)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, k, num, block_rows, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rng = random.Random(k)
    rows = []
    for g in range(6):
        base = words(rng, rng.choice([3, 12, 60, 200])).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, words(rng, 50)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_links(jaccard.jaccard_join(df, k=k, num=num, den=100, block_rows=block_rows)) == brute_links(rows, k, num, 100)


def test_a_large_cell_is_split_and_near_copies_are_one_group():
    import pandas as pd

    n = np.sort(np.random.default_rng(3).integers(100, 160, 500))
    cell = pd.DataFrame({"key": 7, "rep": np.arange(500)[::-1] + 10, "n": n})
    dealt = pd.concat(jaccard._shared(80, 100, 32)(iter([cell])), ignore_index=True)
    tasks = [set(g["rep"]) for _, g in dealt.groupby(["key", "a", "b"])]
    assert max(map(len, tasks)) <= 64 and dealt.groupby(["key", "a", "b"]).size().max() <= 64
    size = dict(zip(cell["rep"], n, strict=True))
    met = {(x, y) for t in tasks for x in t for y in t}
    assert all((x, y) in met for x in size for y in size if size[x] <= size[y] and size[x] * 100 >= size[y] * 80)
    near = dealt.assign(n=dealt["rep"].map(size), counts=[np.full(64, 2, dtype="<u2").tobytes()] * len(dealt)).sort_values(["key", "a", "b", "n"])
    got = pd.concat(jaccard._groups(80, 100)(iter([near])))
    assert set(got["rep"]) == set(size) and len(got) <= 500 * 16
    odd = near.assign(counts=[np.full(64, 2 if r % 2 else 200, dtype="<u2").tobytes() for r in near["rep"]])  # two kinds of sets never meet
    assert all((r - q) % 2 == 0 for r, q in pd.concat(jaccard._groups(80, 100)(iter([odd])))[["rep", "lead"]].itertuples(index=False))


def test_jaccard_join_of_odd_rows(spark, odd_docs):
    got = got_links(jaccard.jaccard_join(odd_docs, k=4, num=85))
    rows = {r.doc_id: r.text for r in odd_docs.collect()}
    assert got == brute_links(rows.items(), 4, 85, 100)
    assert got[4] == (0, 4, 0) and got[6] == (0, 6, 0) and got[9] == (1, 8, 1)
    assert jaccard.jaccard_join(odd_docs.limit(0)).count() == 0


def test_region_recursion_finds_every_pair_once():
    rng = np.random.default_rng(1)
    centers = [rng.integers(0, 2**60, 60, dtype=np.uint64) for _ in range(8)]
    sets = [np.unique(np.concatenate([c[rng.random(60) < 0.93], rng.integers(0, 2**60, 3, dtype=np.uint64)])) for c in centers for _ in range(30)]
    region = jaccard.Region(sets, 80, 100)
    jaccard.LEAF, before = 32, jaccard.LEAF
    try:
        region.join(np.arange(len(sets)), [])
    finally:
        jaccard.LEAF = before
    got = Counter(tuple(sorted(p)) for p in zip(*map(list, region.links()), strict=True))
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert set(got) == want and set(got.values()) <= {1}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)]
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


# 2 exact top-k


def test_top_k_equals_brute_force_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.25] * 6) for i in range(400, 700)] + [(700, None), (701, [None] * 6), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, [0.5, 0.5]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "shard": F.lit("x")})
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=100, block_rows=5).orderBy("query_id", "rank").collect()]
    vec = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in vec if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(vec[q], vec[c], strict=False)), c) for c in vec if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_components_and_few_rows(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    assert got[(0, 1)] == 2**63 - 1 and len(got) == 2


# 3 mixing


def targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), set()
    while True:
        rest = sum(w[s] for s in order if s not in full)
        level = (goal - sum(2 * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in order if s not in full and level * w[s] > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else level * w[s] for s in order}
        full |= more


def test_mix_reaches_targets_and_reruns_agree(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    sizes = Counter()
    for r in odd_docs.collect():
        sizes[r.source] += len(split(r.text))
    want = targets(dict(sizes))
    for s, t in want.items():
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(t) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - t) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs.repartition(7)).collect()))
    assert mixing.mix(odd_docs.limit(0)).count() == 0


def test_curriculum_follows_the_schedule(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", "w " * 10) for i in range(2000)], "doc_id long, source string, text string")
    m = mixing.mix(df, weights=(5, 1), share=1.0)
    rows = mixing.curriculum(m).collect()
    assert [r["at"] for r in rows] == sorted(r["at"] for r in rows) and sum(r.words for r in rows) == sum(r.taken for r in m.collect())
    early = Counter(r.source for r in rows if r["at"] < 0.5)
    all_ = Counter(r.source for r in rows)
    assert early["a"] / all_["a"] > 0.55 and early["b"] / all_["b"] < 0.45  # weight 5 fades, weight 1 comes late
    at = spark.range(1).select(mixing.demand_time(F.lit(0.5), ((0.0, 0.0), (1.0, 2.0))).alias("t")).first().t
    assert at == pytest.approx(math.sqrt(0.5))


# 4 quality rules


def brute_counts(text):
    t = text or ""
    w = split(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(again)


def test_quality_counts_equal_brute_force(spark, odd_docs):
    rng = random.Random(9)
    texts = [None, "", "\n\n", "a b c a b c", "a a a a a", "#*$ %& |<>\n#*$ %& |<>", "x\r\ny\r\nx\r\n", *("\n".join(words(rng, rng.randrange(9), 5) for _ in range(30)) for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(odd_docs.filter("doc_id <> 8").select(F.col("doc_id") + 1000, "text"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(df).collect()}
    assert got == {r.doc_id: brute_counts(r.text) for r in df.collect()}


def test_quality_passing_equals_verdict(spark, odd_docs):
    judged = quality.quality_rules(odd_docs)
    assert quality.passing(odd_docs).columns == odd_docs.columns
    assert sorted(r.doc_id for r in quality.passing(odd_docs).collect()) == sorted(r.doc_id for r in judged.filter("passed").collect())
    assert quality.passing(odd_docs.limit(0)).count() == 0 and quality.quality_rules(odd_docs, rules=()).filter("passed").count() == odd_docs.count()


# 5 sharding


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_histogram_sort(spark, odd_docs, shards):
    rng = random.Random(4)
    rows = [(i, "copy " * 50 if i % 3 == 0 else words(rng, rng.randrange(1, 60))) for i in range(3000)]
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 100))
    got = sharding.histogram_sort(df, shards).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    load = Counter()
    for s in range(shards):
        own = sorted((r.slot, r.key) for r in got if r.shard == s)
        assert [x for x, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
        load[s] = sum(r.size for r in got if r.shard == s)
    mean = sum(load.values()) / shards
    big = max(r.size for r in got)
    assert all(abs(load[s] - mean) <= 0.01 * mean + big for s in range(shards)) and len(got) == df.count()
    assert sharding.histogram_sort(df.limit(0), shards).count() == 0


# 6 suffix-array dedup


def brute_passages(rows, least):
    seen = {}
    for i, t in sorted(rows):
        w = split(t)
        for p in range(len(w) - least + 1):
            seen.setdefault(tuple(w[p : p + least]), []).append((i, p))
    again, later = Counter(), Counter()
    for at in seen.values():
        at = sorted(set(at))
        if len(at) > 1:
            for n, (i, p) in enumerate(at):
                for x in range(p, p + least):
                    again[i, x] = 1
                    later[i, x] |= n > 0
    return {k for k in again}, {k for k, v in later.items() if v}


@pytest.mark.parametrize(("least", "k", "hot"), [(50, None, 1000), (20, 8, 1), (12, 12, 2)])
def test_passages_equal_brute_force(spark, odd_docs, least, k, hot):
    rng = random.Random(least)
    shared = [words(rng, n) for n in (least - 1, least, least + 1, 3 * least)]
    rows = [(i, " ".join([words(rng, rng.randrange(80)), rng.choice(shared), words(rng, rng.randrange(80)), rng.choice(shared)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 100).union(odd_docs.select("doc_id", "text"))
    found = suffixes.repeated_passages(df, least=least, k=k, hot=hot).collect()
    cover = lambda name: {(r.doc_id, x) for r in found for s in r[name] for x in range(s.start, s.end)}
    assert (cover("spans"), cover("later")) == brute_passages({(r.doc_id, r.text) for r in df.collect()}, least)
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


def test_cut_out_leaves_other_words_alone(spark):
    df = spark.createDataFrame([(1, "a  b\nc d"), (2, "x y"), (3, None), (4, "p q")], "doc_id long, text string").withColumn("start", F.lit(1))
    cuts = spark.createDataFrame([(1, [(1, 2)]), (2, [(0, 2)]), (4, [])], f"doc_id long, later {suffixes.SPANS}")
    assert {r.doc_id: r.text for r in suffixes.cut_out(df, cuts).collect()} == {1: "a  c d", 3: None, 4: "p q"}


# 7 token files


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(0)
    blocks = [np.zeros(0, dtype=int), np.array([5]), np.zeros(300, dtype=int), rng.integers(0, 3, 1000), rng.integers(0, 49408, 70), *(rng.zipf(1.3, rng.integers(1, 400)) % 49408 for _ in range(40))]
    data = tokencode.encode_blocks(blocks, 49408)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, tokencode.decode_blocks(data, 49408), strict=True))
    assert tokencode.encode_blocks(blocks[3:4], 49408) == data[3:4]  # a block does not depend on its neighbours
    assert len(data[2]) < 40 and len(data[3]) < 1000
    broken = bytes([*data[3][:20], data[3][20] ^ 1, *data[3][21:]])
    with pytest.raises(ValueError, match="checksum"):
        tokencode.decode_blocks([broken], 49408)
    with pytest.raises(ValueError):
        tokencode.encode_blocks([np.array([49408])], 49408)


def test_token_file_round_trip(spark, odd_docs):
    from tokenizers import Tokenizer

    model = queries.tokenizer_path("word_bpe_49k.json")
    path = shared_path(spark, "test-tokens")
    tokenfile.write_tokens(odd_docs, model, path, end=2, block_size=64, record_size=500)
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    tok, at = Tokenizer.from_file(model), 0
    for r, (i, t) in zip(got, sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda x: x[0]), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.tokens) == (i, at, len(ids), ids.tobytes())
        at += len(ids)
    empty = shared_path(spark, "test-tokens")
    tokenfile.write_tokens(odd_docs.limit(0), model, empty, end=2)
    assert tokenfile.read_tokens(spark, empty).count() == 0


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    model = queries.tokenizer_path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(model), tokenfile.ChunkTokenizer(open(model, encoding="utf-8").read(), remember=50)
    rng = random.Random(1)
    texts = ["", "a\x01b \x01 c", "<|endoftext|> x<|startoftext|>", "é ́x", "I'LL'll  don't ΣΑΣ x", *("".join(rng.choices("abcDE 'é.\n\t1́\x01日", k=60)) for _ in range(300))]
    flat, sizes = own.encode(texts, 2)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


# 8 SentencePiece


def test_pieces_equal_the_library(spark, odd_docs):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(open(path, "rb").read(), remember=300)
    rng = random.Random(6)
    vocab = [lib.id_to_piece(i) for i in range(300, 32000, 61)]
    texts = ["", " ", "  a  b ", "\n\n x", "▁ ▁▁a", "<s> </s><0x0A>", "\x00\x7f é́ 日本\U0001f600", "a" * 3000, *("".join(rng.choices("abest ▁\n.Aéß1", k=rng.randrange(200))) for _ in range(300)),
             *("".join(rng.choices(vocab, k=15)).replace("▁", " ") for _ in range(200))]
    flat, sizes = own.encode(texts)
    want = [lib.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want
    assert own.decode(flat, sizes) == [lib.decode(x) for x in want]
    cut = [259, 200, 131, 259, 13]  # a byte that is no character
    assert own.decode(np.array(cut), np.array([len(cut)])) == [lib.decode(cut)]
    rows = pieces.decode(pieces.encode(odd_docs, path), path).collect()
    assert all(list(r.ids) == lib.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == lib.decode(list(r.ids)) for r in rows)
    one = {r.doc_id: r for r in pieces.transcode(odd_docs, path).collect()}
    assert all(one[r.doc_id].ids == np.array(r.ids, dtype="<u4").tobytes() and one[r.doc_id].decoded == r.decoded for r in rows)
    assert pieces.transcode(odd_docs.limit(0), path).count() == 0


# 9 license scans


@pytest.mark.parametrize(("text", "label", "hit"), [
    ("Released under the MIT License.", "mit", True), ("released under the terms of the MIT license", "mit", True), ("released under some MIT license", "mit", False),
    ("Copyright 2020 Jane Doe. All rights reserved", "all-rights", True), ("copyright a b c d e f g all rights reserved", "all-rights", False),
    ("Licensed under the GNU General Public License, version 3", "gpl", True), ("licensed under the gnu general private license version 3", "gpl", False),
])
def test_templates(text, label, hit):
    assert (label in licenses.Scanner({}, licenses.TEMPLATES).scan(text)[5].split(",")) is hit


def test_automata_equal_regular_expressions():
    import re

    rng = random.Random(8)
    for _ in range(200):
        t = " ".join(rng.choice(["a", "b", "<<optional>> a <<end>>", "<<any 2>>", "<<optional>> b <<optional>> a <<end>> <<end>>"]) for _ in range(5)) + " c"
        a = licenses.compiled("x", t)
        form = queries._template_sql(t)[1:]
        for _ in range(20):
            w = rng.choices(["a", "b", "c", "d"], k=rng.randrange(9))
            m = [len(m[0].split()) for n in range(len(w) + 1) if (m := re.fullmatch(form, "".join(x + " " for x in w[:n])))]
            assert a.ends([x.encode() for x in w], 0) == max(m, default=None)
    with pytest.raises(ValueError):
        licenses.compiled("x", "<<optional>> a")


def test_license_scan_of_odd_rows(spark, odd_docs):
    df = odd_docs.withColumn("labels", F.lit("clash")).union(odd_docs.limit(1).withColumns({"text": F.lit("Under the MIT License, under the mit license! CC-BY-NC"), "labels": F.lit("")}))
    rows = licenses.license_scan(df).collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows if r.n_base] == [(3, 0, 8, "cc-by-nc,mit")]
    assert {r.doc_id: r.n_words for r in rows}[4] == 0 and licenses.license_scan(df.limit(0)).count() == 0


# 10 tool calls


def test_calls_link_validate_and_order(spark):
    schema = {"add": {"x": toolcalls.Field("integer", low=0, high=9), "note": toolcalls.Field("string", required=False, high=3)}}
    calls = spark.createDataFrame([
        ("c", "a", "add", '{"x": 1}', ["b"], 1), ("c", "b", "add", '{"x": 10}', [], 2), ("c", "d", "add", '{"y": 1, "x": "1.5"}', ["a", "zz", None], 3), ("c", None, "add", None, None, 4),
        ("k", "p", "other", "{}", ["q"], 1), ("k", "q", "add", '{"x": 3, "note": "long"}', ["p"], 2), (None, "n", "add", '{"x": 2, "note": "a\\"é"}', None, 1)],
        "conv_id string, call_id string, tool string, arguments string, refs array<string>, seq long")
    results = spark.createDataFrame([("c", "a", "2"), ("c", "a", "1"), ("c", "nobody", "x"), (None, "n", None)], "conv_id string, call_id string, content string")
    linked = toolcalls.linked_calls(calls, results, schema)
    got = {(r.conv_id, r.call_id): (r.level, r.faults, r.answered, r.content) for r in linked.collect()}
    assert got[("c", "a")] == (1, [], True, "1") and got[("c", "b")] == (0, ["x"], False, None) and got[("c", "d")] == (2, ["x", "y"], False, None)
    assert got[("k", "p")][:2] == (None, ["?"]) and got[("k", "q")][:2] == (None, ["note"]) and got[(None, "n")] == (0, [], True, None)
    rows = {r.conv_id: r for r in toolcalls.conversations_json(linked).collect()}
    assert (rows["c"].n_calls, rows["c"].n_linked, rows["c"].n_orphans, rows["c"].depth, rows["k"].n_cyclic) == (4, 1, 1, 3, 2)
    import json

    body = json.loads(rows["c"].json)
    assert [x["id"] for x in body["calls"]] == ["b", "a", "d", None] and body["orphans"] == [{"id": "nobody", "result": "x"}]
    assert rows["c"].json == json.dumps(body, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert toolcalls.conversations_json(toolcalls.linked_calls(calls.limit(0), results.limit(0), schema)).count() == 0


def test_arguments_keep_their_json_types(spark):
    import json

    schema = {"add": {"b": toolcalls.Field("boolean", required=False), "f": toolcalls.Field("number", required=False), "o": toolcalls.Field("string", required=False, high=3), "x": toolcalls.Field("integer", low=0, high=9)}}
    texts = {  # arguments: faults
        '{"x": 3, "o": "a", "f": 1.5, "b": true}': [], '{"x": "3"}': ["x"], '{"x": true}': ["x"], '{"x": 1.5}': ["x"], '{"x": null}': ["x"], '{"x": 10}': ["x"], '{"x": 3, "b": "true"}': ["b"],
        '{"x": 3, "f": "1.5"}': ["f"], '{"x": 3, "f": 2}': [], '{"x": 3, "o": 1}': ["o"], '{"x": 3, "o": {"z": [1, {"k": null, "a": "\\n\\"é"}], "a": false}}': ["o"], '{"x": 3, "z": [true, "1"]}': ["z"],
        '{"x": 12345678901234567890123456789012345678901234}': ["x"], '{"x": 3, "f": "Infinity"}': ["f"]}
    bad = ['{"x": 1, "x": 2}', '[1]', "null", "x", "", '{"x": 3, "f": 1e999}', None]
    calls = spark.createDataFrame([(f"c{i}", "a", "add", t, None, 1) for i, t in enumerate([*texts, *bad])], "conv_id string, call_id string, tool string, arguments string, refs array<string>, seq long")
    linked = toolcalls.linked_calls(calls, spark.createDataFrame([], "conv_id string, call_id string, content string"), schema)
    got = {r.conv_id: json.loads(r.json)["calls"][0] for r in toolcalls.conversations_json(linked).collect()}
    for i, (t, faults) in enumerate(texts.items()):
        assert (got[f"c{i}"]["faults"], json.dumps(got[f"c{i}"]["arguments"])) == (faults, json.dumps(json.loads(t), sort_keys=True)), t
    for i, t in enumerate(bad, len(texts)):
        assert (got[f"c{i}"]["faults"], got[f"c{i}"]["arguments"]) == (["?"], t), t


def test_a_turn_is_an_integer(spark):
    import json

    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    calls, results, others = toolcalls.calls_of_turns(turns)
    r = toolcalls.conversations_json(toolcalls.linked_calls(calls, results, toolcalls.REPLY), others).first()
    assert r.n_invalid == 0 and [c["arguments"] for c in json.loads(r.json)["calls"]] == [{"prompt": "a", "turn": 0}, {"follows": "call-0", "prompt": "c", "turn": 2}]


def test_fold_and_rounds_give_the_same_levels(spark):
    rng = random.Random(1)
    calls = [(f"v{v}", f"k{i}", [f"k{rng.randrange(i)}" for _ in range(rng.randrange(3))] if i else [], i) for v in range(4) for i in range(12)]
    df = spark.createDataFrame(calls, "conv string, call_id string, refs array<string>, seq long")
    rows = lambda d: {(r.conv, r.call_id): r.level for r in d.collect()}
    assert rows(toolcalls.levels(df)) == rows(toolcalls.levels(df, fold=1))


# whole queries and the pipeline


def test_sharding_and_top_k_queries_have_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    r = queries.QUERIES["op5_sharding"](spark, sf)
    assert r.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and r.select("shard").distinct().count() == 40


def test_pipeline_equals_brute_force(spark, tmp_path):
    import sentencepiece

    rng = random.Random(11)
    stops = ["the", "of", "and", "to"]
    text = lambda n: " ".join(rng.choice(stops) if i % 4 == 0 else f"w{rng.randrange(3000)}" for i in range(n))
    passage = text(60)
    rows = [(i, text(rng.randrange(60, 200)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(5)]  # copies
    rows += [(200 + i, rows[i][1] + " tail", "en", "s2", 1) for i in range(5)]  # near copies
    rows += [(300 + i, text(70) + " " + passage + " " + text(50), "de", None, 1) for i in range(4)]
    rows += [(400, "too short", "en", "s0", 1), (401, None, None, None, None), (402, "### $$$ " * 60, "en", "s0", 1)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "sf/documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()

    docs = {i: (t, s) for i, t, _, s, _ in rows if t and len(t.split()) >= 50 and "#" not in t}
    comp = brute_links([(i, t) for i, (t, _) in docs.items()], 5, 80, 100)
    docs = {i: d for i, d in docs.items() if comp[i][1] == i}
    _, later = brute_passages([(i, t) for i, (t, _) in docs.items()], 50)
    docs = {i: (" ".join(w for k, w in enumerate(t.split()) if (i, k) not in later), s) for i, (t, s) in docs.items()}
    docs = {i: d for i, d in docs.items() if d[0]}
    sizes = Counter()
    for t, s in docs.values():
        sizes[s] += len(t.split())
    goal, taken = targets(dict(sizes)), Counter()
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for r in got:
        whole = docs[r.doc_id][0].split()
        mine = r.decoded.split()
        assert mine == whole[: len(mine)] and np.frombuffer(r.ids, dtype="<u4").tolist() == lib.encode(r.decoded, add_bos=True, add_eos=True)
        taken[r.source] += len(mine)
    assert all(abs(taken[s] - t) <= 1 for s, t in goal.items())
    assert sum(len(r.decoded.split()) < len(docs[r.doc_id][0].split()) for r in got) <= len(goal)
    assert 400 not in {r.doc_id for r in got} and not {100, 200} & {r.doc_id for r in got}


def test_stages_of_odd_rows(spark, odd_docs):
    docs = odd_docs.union(odd_docs.filter("doc_id IN (1, 7)").withColumn("doc_id", F.lit(None).cast("long")))
    assert corpus_pipeline.jaccard_stage(spark, docs, "").filter("doc_id IS NULL").count() == 2
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == corpus_pipeline.COLUMNS
        stored(out, "stage")
        assert stage(spark, docs.limit(0), "").count() == 0
