"""Conversation trie, personal data and hard negatives: brute force, held-out accuracy, odd rows, and their registered queries."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.llm import negatives, pii, queries, tagger, toolcalls, topk, trie
from meshlake.llm.topk import LIMIT


@pytest.fixture(scope="session")
def spark():
    from meshlake.session import local_session

    s = local_session(4, shuffle_partitions=4, memory="6g")
    if not s.conf.get("spark.checkpoint.dir", None):
        pytest.skip("spark.checkpoint.dir is not set")
    return s


# 11 conversation prefix trie


def brute_trie(rows):
    """(conv_id, depth) of every node with its figures, from plain dictionaries."""
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    conv = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in conv.items()}
    nodes = {(): {"in": [], "ends": [], "kids": set(), "words": 0, "top": None}}
    for c, own in conv.items():
        h, b = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = ()
        nodes[path]["in"].append(c)
        for turn in conv.get(b, [])[:h] + own[h:]:
            n = nodes.setdefault((*path, turn), {"in": [], "ends": [], "kids": set(), "words": len(turn[1].encode().split()), "top": path})
            nodes[path]["kids"].add(turn)
            path = (*path, turn)
            n["in"].append(c)
        nodes[path]["ends"].append(c)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        n = nodes[path]
        below = [nodes[(*path, k)] for k in n["kids"]]
        n["leaves"] = sum(x["leaves"] for x in below) if below else 1
        n["saved"] = (len(n["in"]) - 1) * n["words"] + sum(x["saved"] for x in below)
        if n["in"]:
            top = None if n["top"] is None else min(nodes[n["top"]]["in"])
            out[min(n["in"]), len(path)] = (top, len(n["in"]), len(below), n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
    return out


def got_trie(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


TURNS = "conv_id long, turn long, role string, text string"


def odd_turns():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "a  b", ""])) for c in range(-25, 60) if c % 20 or c == 0 or rng.random() < 0.7 for t in range(rng.randint(1, 5))]
    rows += [(70, None, "user", "no number"), (70, 0, None, None), (70, 0, None, None), (71, 5, "user", "z"), (71, 5, "user", "y"), (None, 0, "user", "no conversation"), (100, 0, "system", "x " * 30000)]
    rows += [(80 + i % 2, i, "user", f"long {i // 2}") for i in range(120)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("last", [1, 60, 1 << 14])
def test_trie_equals_brute_force(spark, last):
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).withColumns({"place": F.lit("clash"), "digest": F.lit(1), "mark": F.lit(2), "depth": F.lit(None).cast("int")})
    turns, convs = trie.shared_starts(trie.numbered_turns(df.repartition(5)))
    out = trie.prefix_trie(turns, convs, last=last)
    assert got_trie(out) == brute_trie(rows)
    arcs = sorted(x for r in out.collect() for x in (r.enter, r.leave))
    assert arcs == list(range(len(arcs)))


def test_trie_without_rows(spark):
    turns, convs = trie.shared_starts(trie.numbered_turns(spark.createDataFrame([], TURNS)))
    assert trie.prefix_trie(turns, convs).collect() == []


def test_a_list_is_ranked_by_rounds(spark):
    n = 500
    name = lambda i: f"named_struct('conv_id', {i}, 'depth', 0L, 'leaves_it', false)"
    mixed = "pmod(xxhash64(id), 1000003) * 1000 + id"
    arcs = spark.range(n).selectExpr(f"{name(mixed)} arc", f"if(id < {n - 1}, {name(mixed.replace('id', '(id + 1)'))}, null) next", "1L steps", "id w", "id")
    got = trie.list_ranks(arcs.drop("id"), ("steps", "w"), last=5).join(arcs.select("arc", "id"), "arc").collect()
    assert len(got) == n and all(r.steps == r.id and r.w == r.id * (r.id - 1) // 2 for r in got)


def test_trie_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(queries.QUERIES["op11_conversation_prefix_trie"](spark, d)) == brute_trie(rows)


# 12 personal data


def plain_base(text):
    """The rules as patterns, without any care for speed."""
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        x = [int(c) for c in d[::-1]]
        return (sum(x[::2]) + sum(sum(divmod(2 * y, 10)) for y in x[1::2])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_rules_equal_plain_patterns():
    rng = random.Random(9)
    pieces = ["a.b", "@", "@@", "x@y.z", ".", "..", "1", "25", "256", "1.2.3.4", "4111111111111111", "4111 1111 1111 1111", " ", "-", "+", "+1 (017) 555-7713", "(", ")", "é", "\n", "0000.1.2.3", "٣", "_%"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert [tuple(s) for s in pii.base_spans(text)] == plain_base(text), text


def test_rules_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)


def test_windows_cover_every_mark():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab 1@" if rng.random() < 0.1 else "ab cd") for _ in range(rng.randint(0, 600)))
        starts = pii.windows_of(text)
        for m in pii.MARK.finditer(text):
            assert any(a <= max(0, m.start() - 8) and min(len(text), m.end() + 8) <= a + pii.WINDOW for a in starts)


def test_reconciled_is_the_heaviest_set():
    rng = random.Random(6)
    for _ in range(200):
        spans = [(pii.Span("ip", a, a + rng.randint(1, 6)), rng.choice([-1.0, 1.0, 2.0, 4.0])) for a in (rng.randrange(12) for _ in range(6))]
        total = {}
        for s, w in spans:
            if w > 0:
                total[s] = total.get(s, 0) + w
        best = 0.0
        keys = list(total)
        for mask in range(1 << len(keys)):
            some = sorted((keys[i] for i in range(len(keys)) if mask >> i & 1), key=lambda s: s.start)
            if all(x.end <= y.start for x, y in zip(some, some[1:], strict=False)):
                best = max(best, sum(total[s] for s in some))
        got = pii.reconciled(spans)
        assert all(x.end <= y.start for x, y in zip(got, got[1:], strict=False)) and sum(total[s] for s in got) == best


def test_tagger_gradients_equal_differences():
    rng = np.random.default_rng(1)
    m = tagger.fresh(5, embed=4, hidden=3)
    ids, tags = rng.integers(0, 20, (3, 7)), rng.integers(0, 5, (3, 7))
    for p, d in zip(m, tagger.gradients(m, ids, tags)[1], strict=True):
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = tagger.gradients(m, ids, tags)[0]
            p[i] = old - 1e-5
            down = tagger.gradients(m, ids, tags)[0]
            p[i] = old
            assert abs((up - down) / 2e-5 - d[i]) < 1e-7


@pytest.fixture(scope="session")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.learned(docs.filter("doc_id % 3 <> 0"), most=900)


def test_tagger_finds_held_out_spans(spark, learned):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 3 = 0 and text rlike '[0-9@]'").select("text").collect()]
    hit = wrong = missed = 0
    for text in rows:
        want = {s for s in pii.base_spans(text, checked=False)}
        starts = pii.windows_of(text)
        found = []
        for a, spans in zip(starts, pii.tagged(learned, [text[a : a + pii.WINDOW] for a in starts]), strict=True):
            edge = min(len(text), a + pii.WINDOW) - a
            found += [(pii.Span(s.kind, a + s.start, a + s.end), w) for s, w in spans if (s.start or not a) and (s.end < edge or a + edge == len(text))]
        got = set(pii.reconciled(found))
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.9 and hit / (hit + missed) > 0.9, (hit, wrong, missed)


def test_tagger_adds_phones_and_leaves_the_rest(spark, learned):
    rows = [(1, "le la Call (212) 555-0142 hast the"), (2, "the re eau 4111111111111112 onble la"), (3, "thnt +1 (017) 555-7713 10.20.30.40 eaux"), (4, "version 3. CC BY 4.0. in 1999 and 12 of 7"), (5, None), (6, ""), (None, "x@y.de"),
            (7, "word " * 20000 + "mail a.b@c.org " + "end " * 20000), (7, "a@b.c"), (7, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "kind": F.lit("x"), "start": F.lit(None).cast("int")})
    out = pii.personal_data(df, model=learned).collect()
    assert len(out) == len(rows) and {"doc_id", "kind", "start", "spans"} == set(out[0].asDict())
    told = {r.doc_id: [(s.kind, s.start, s.end, s.added) for s in r.spans] for r in out if r.doc_id != 7}
    assert told[1] == [("phone", 11, 25, True)] and told[2] == told[4] == told[5] == told[6] == []
    assert ("ip", 23, 34, False) in told[3]
    assert told[None] == [("email", 0, 6, False)]
    assert sorted(len(r.spans) for r in out if r.doc_id == 7) == [1, 1, 1] and any(s.start == 100_005 for r in out if r.doc_id == 7 for s in r.spans)
    assert pii.personal_data(df.filter("doc_id < 0")).collect() == []


def test_personal_data_query(spark):
    d = "/root/testdata/sf0.001"
    out = queries.QUERIES["op12_personal_data"](spark, d).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        want = plain_base(texts[r.doc_id])
        told = ",".join(":".join(map(str, s)) for s in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


# 13 hard negatives


def brute_negatives(rows, every=3, k=2, low=80, high=100, scale=256):
    def cut(s):
        return max(-LIMIT - 1, min(LIMIT, s))

    seen = sorted({(i, label, tuple(int(np.floor(scale * float(x))) for x in v)) for i, label, v in rows
                   if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    dot = lambda a, b: cut(sum(x * y for x, y in zip(a, b, strict=False)))
    out, done = [], set()
    for i, label, v in seen:
        if i % every or i in done:
            continue
        done.add(i)
        others = [(dot(v, w), j, m) for j, m, w in seen if j != i]
        for s, p, _ in sorted((x for x in others if x[2] == label), key=lambda x: (-x[0], x[1]))[:k]:
            fit = sorted((x for x in others if x[2] != label and low * s <= 100 * x[0] <= high * s), key=lambda x: (-x[0], x[1]))[:k]
            out += [(i, p, r + 1, n, s, t) for r, (t, n, _) in enumerate(fit)]
    return sorted(out)


def vectors(kind):
    rng = np.random.default_rng(8)
    if kind == "clusters":
        centre = rng.normal(size=(5, 8))
        rows = [(i, str(i % 3), (centre[i % 5] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
        return rows + [(400 + i, "0", [0.0] * 8) for i in range(5)] + [(500 + i, str(i % 2), centre[0].tolist()) for i in range(90)]
    if kind == "huge":
        return [(i, str(i % 2), (rng.normal(size=3) * 10.0 ** rng.integers(0, 160)).tolist()) for i in range(60)]
    rows = [(i, str(i % 2), rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)]
    return rows + [(3, "1", [1.0, 2.0]), (3, "0", [9.0]), (6, None, [1.0] * 4), (None, "0", [1.0] * 4), (9, "0", None), (12, "0", [1.0, None]), (15, "1", [float("nan")] * 4), (18, "1", [float("inf")]), (21, "0", [])] + rows[:20]


@pytest.mark.parametrize("kind", ["clusters", "huge", "odd"])
@pytest.mark.parametrize("sizes", [(8192, 4096), (40, 10)])
def test_negatives_equal_brute_force(spark, kind, sizes):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").withColumns({"v": F.lit("clash"), "norm": F.lit(0), "shard": F.lit(1), "score": F.lit(None).cast("int")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, positives=2, negatives=2, references=4, shard_rows=sizes[0], block_rows=sizes[1])
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert negatives.hard_negatives(df.filter("vec_id < 0"), F.col("vec_id") % 3 == 0).collect() == []


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(2)
    points = np.floor(256 * np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(300, 6)) * 0.05 + 1, np.zeros((3, 6))]))
    norms, angles = negatives.measured(points, np.eye(6)[:4])
    for i in range(0, 603, 7):
        low, high = negatives.score_bounds(norms[i], angles[i], norms, angles)
        s = points @ points[i]
        assert (low <= s).all() and (s <= high).all()
    low, high = negatives.score_bounds(norms[400], angles[400], norms, angles)
    assert ((high - low) < 2 * norms[400] * norms).mean() > 0.5


def test_few_rows_are_scored():
    rng = np.random.default_rng(5)
    import pandas as pd

    points = np.floor(256 * (rng.normal(size=(20, 4))[rng.integers(0, 20, 2000)] + 0.05 * rng.normal(size=(2000, 4))))
    norms, angles = negatives.measured(points, np.eye(4))
    shard = negatives.Shard(pd.DataFrame({"vec_id": np.arange(2000), "label": ["a"] * 1000 + ["b"] * 1000, "v": list(points), "norm": norms, "angles": list(angles)}), 4)
    best = int(np.sort(points[:1000] @ points[0])[-2])
    shard.between(points[0], norms[0], angles[0], 0, "a", [negatives.allowed(best, 90, 100)], 5)
    assert 0 < shard.scored < 500


def test_negatives_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, str((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label), r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_hard_negative_mining"](spark, d)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, every=100, k=5)


# results that depended on the order of rows or mixed keys


def test_top_k_does_not_depend_on_the_order_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 5.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    want = None
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = topk.top_k(spark.createDataFrame(order, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 0, k=5, scale=1, shard_rows=2)
        got = sorted(map(tuple, got.collect()))
        assert got == (want := want or got)
    # the query is the smaller vector of id 0, [0, 5]
    assert want == [(0, 1, 1, 15), (0, 2, 2, 5), (0, 3, 1, 0)]


def test_null_and_empty_conversation_ids_link_apart(spark):
    calls = spark.createDataFrame([(None, "a", "reply", "{}", [], 0), ("", "a", "reply", "{}", [], 0)], "conv_id string, call_id string, tool string, arguments string, refs array<string>, seq long")
    results = spark.createDataFrame([(None, "a", "of null"), ("", "a", "of empty")], "conv_id string, call_id string, content string")
    got = {r.conv_id: r.content for r in toolcalls.linked_calls(calls, results, toolcalls.REPLY).collect()}
    assert got == {None: "of null", "": "of empty"}
    out = toolcalls.conversations_json(toolcalls.linked_calls(calls, results, toolcalls.REPLY)).collect()
    assert sorted((r.n_calls, r.n_linked) for r in out) == [(1, 1), (1, 1)]
