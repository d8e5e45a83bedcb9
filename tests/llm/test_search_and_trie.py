"""Conversation trie, exact top-k and ranked search against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EXTRA, SMALL, duck_dir, edge_docs, edge_rows, same
from tidewatch.llm import lexical, topk, trie


TURNS = "conv_id long, turn long, role string, text string"
CLASHES = [*EXTRA, "conv", "pos", "tid", "words", "block", "part", "place", "a", "b", "tag", "v", "score", "rank"]


def clashing(df):
    for k, name in enumerate(c for c in CLASHES if c not in df.columns):
        df = df.withColumn(name, F.lit(k))
    return df


def turn_rows():
    rng = random.Random(5)
    rows = []
    for c in list(range(0, 50)) + [-3, 120, 121, 139, 10**15]:
        size = rng.choice([1, 1, 2, 3, 4, 7, 12])
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "hello there you", "", "yes", "ok  then"])) for t in range(size)]
    rows += [(20, 100 + t, "user", f"turn {t % 3}") for t in range(40)]
    rows += [(c, 100 + t, "user", "same words again") for c in (60, 61, 62) for t in range(30)]
    rows += [(7, None, None, "first"), (7, None, "user", None), (8, 0, "user", "hi"), (8, 0, "user", "hi"), (8, 0, "bot", "hi"),
             (9, 1, "us", "erx"), (10, 1, "user", "x"), (63, 5, None, None), (None, 1, "user", "nobody"), (None, None, None, None),
             (64, 1, "user", "long " * 20000)]
    return rows


def brute_trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * words
    return sorted((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(own) if built[c] == node).encode()).hexdigest())
                  for node, own in members.items())


@pytest.mark.parametrize("width", [3, 8])
def test_trie_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 2)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = turn_rows()
    got = trie.conversation_trie(clashing(spark.createDataFrame(rows, TURNS)), width=width)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_trie(rows)


def test_trie_empty_tables(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0


def test_trie_of_given_turns_only_root(spark):
    # conversation 1 keeps nothing: its own turns are replaced by an absent base
    c = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 4 >= 1)
    got = trie.conversation_trie(spark.createDataFrame([(c, 0, "user", "gone")], TURNS)).collect()
    assert [tuple(r)[:7] for r in got] == [(c, 0, None, 1, 0, 1, 0)]
    assert got[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_trie_equals_sql(spark):
    con = duck_dir(SMALL)
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    same(trie.op11_conversation_trie(spark, SMALL), con, trie.SQL)


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in map(float, v)]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if i is None or math.fmod(i, 100):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, (j, w) in enumerate(ok) if m != n]
        out += [(i, r, None if null else j, max(-2**63, min(2**63 - 1, -s))) for r, (s, null, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(size=6) * (1 + i % 3)).tolist(), 0) for i in range(150)]
    rows += [(200, [0.0] * 6, 1), (300, None, 1), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (500, [float("nan")] * 6, 1), (600, [float("inf")] + [0.0] * 5, 1),
             (700, [0.5, -0.25], 1), (800, [], 1), (None, [1.0] * 6, 1), (100, rows[100][1], 1), (7, rows[7][1], 2), (-100, [-0.0009] * 6, None)]
    return rows


def test_top_k_edge_rows(spark):
    rows = vector_rows()
    got = topk.exact_top_k(clashing(spark.createDataFrame(rows, VECTORS)))
    assert got.columns == ["query_id", "rank", "id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows)


def test_top_k_blocks_of_queries_and_small_k(spark):
    rows = vector_rows()
    got = topk.exact_top_k(spark.createDataFrame(rows, VECTORS), k=3, query_values=6)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 3)


def test_top_k_huge_components(spark):
    rows = [(i, [float(v) * 3e12, 1e15 / (i + 1), 2.0**-12], 0) for i, v in enumerate([1, -2, 3, 5, -7] * 30)]
    rows = [(i, np.float32(v).tolist(), x) for i, v, x in rows]
    assert sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, VECTORS)).collect()), key=str) == brute_top(rows)


def test_top_k_empty(spark):
    assert topk.exact_top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], VECTORS)).count() == 0


def test_sorted_lists_bound_the_scores():
    rng = np.random.default_rng(1)
    x, q = np.floor(rng.normal(size=(300, 8)) * 100), np.floor(rng.normal(size=(5, 8)) * 100)
    lists, whole = topk.SortedLists(x), x @ q.T
    width = np.inf
    for depth in (1, 10, 100, 300):
        lower, upper = lists.bounds(depth, np.maximum(q, 0), np.minimum(q, 0))
        assert (lower <= whole).all() and (whole <= upper).all() and (upper - lower).sum() <= width
        width = (upper - lower).sum()
    assert width == 0


def test_top_k_equals_sql(spark):
    same(topk.op12_exact_top_k(spark, SMALL), duck_dir(SMALL), topk.SQL)


ITEMS = "item_id long, text string"


def brute_search(docs, items, k=20):
    def terms(text):
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_search_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", 3)
    docs = edge_rows()
    items = [(1, "alpha beta Gamma beta"), (1, "word7 WORD8 nothing"), (2, None), (3, ""), (4, "!!! ---"), (None, "çé one"), (5, "unknown words only"),
             (6, " ".join(f"word{i}" for i in range(6000))), (7, "x y x"), (8, "12345 identifier")]
    got = lexical.ranked_search(edge_docs(spark, docs), clashing(spark.createDataFrame(items, ITEMS)))
    assert got.columns == ["item_id", "rank", "id", "score"]
    want = brute_search([(r[0], r[1]) for r in docs], items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    parts = lexical.ranked_search(edge_docs(spark, docs), spark.createDataFrame(items, ITEMS), block_terms=1500, k=4)
    assert sorted(map(tuple, parts.collect()), key=str) == brute_search([(r[0], r[1]) for r in docs], items, 4)


def test_search_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 2000)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, "common line of words" if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(900)]
    items = [(j, " ".join(rng.choices(words + ["common"], k=8))) for j in range(15)] + [(99, "line of")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = lexical.ranked_search(df.repartition(5), spark.createDataFrame(items, ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items)


def test_search_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert lexical.ranked_search(edge_docs(spark, []), items).count() == 0
    assert lexical.ranked_search(edge_docs(spark), spark.createDataFrame([], ITEMS)).count() == 0


def test_ball_limits_hold_all_scores():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 12, 400)
    bounds = np.concatenate(([0], np.cumsum(size)))
    terms = np.concatenate([np.sort(rng.choice(60, n, replace=False)) for n in size])
    values, weight = rng.integers(1, 10**6, len(terms)), rng.integers(0, 14_000, 60)
    tree = lexical.BallTree(bounds, terms, values, weight)
    own = [np.unique(rng.integers(0, 60, 9), return_counts=True) for _ in range(7)]
    counts = tree.columns(own)
    limits = tree.limits(counts)
    for q in range(len(own)):
        exact = np.array([sum(int(counts[q, tree.terms[j]]) * int(weight[tree.present[tree.terms[j]]]) * int(tree.values[j])
                              for j in range(tree.start[i], tree.start[i + 1])) for i in range(400)])
        for node, (lo, hi, inner) in enumerate(tree.nodes):
            assert limits[node, q] >= exact[lo:hi].max()
            if not inner:
                assert (tree.scores(node, counts[q].astype(np.int64) * weight[tree.present]) == exact[lo:hi]).all()


def test_search_equals_sql(spark):
    con = duck_dir(SMALL)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    same(lexical.op13_ranked_search(spark, SMALL), con, lexical.SQL)
