"""Exact, near and substring duplicates against SQL and brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SMALL, duck_dir, edge_docs, edge_rows, same
from tidewatch.llm import exact, jaccard, suffixes, vectors
from tidewatch.llm.common import Scratch
from tidewatch.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def classes(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_edge_rows(spark, keep):
    rows = [r for r in edge_rows() if r[0] is not None]
    got = sorted(map(tuple, exact.exact_dedup(edge_docs(spark, rows), keep=keep).collect()))
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    best = max if keep == "largest" else min
    want = sorted((i, best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert got == want


def test_exact_null_id_and_empty(spark):
    got = exact.exact_dedup(edge_docs(spark)).where("id is null").collect()
    assert len(got) == 1 and got[0]["kept"] and got[0]["group_size"] == 1
    assert exact.exact_dedup(edge_docs(spark, [])).count() == 0


def test_exact_common_opening_and_large_group(spark):
    rows = [(i, ("x" * 100) + ("same" if i % 3 else str(i)), None, None, None) for i in range(300)]
    got = exact.exact_dedup(edge_docs(spark, rows)).where("group_size > 1").collect()
    assert {r["keep_id"] for r in got} == {1} and len(got) == 200


def test_exact_hot_texts_below_one_opening(spark):
    """Two hot texts and many rare ones share an opening; runs join across parts."""
    tails = ["one"] * 120 + ["two"] * 90 + [str(i // 2) for i in range(60)]
    rows = [(i, "y" * 80 + tail + ("Z" if i % 5 else "z"), None, None, None) for i, tail in enumerate(tails)]
    rows += [(1000 + i, f"text {i}", None, None, None) for i in range(40)] + [(0, rows[0][1], None, None, None)]
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text.lower(), []).append(i)
    got = sorted((r["id"], r["keep_id"], r["group_size"]) for r in exact.exact_dedup(edge_docs(spark, rows)).collect())
    assert got == sorted((i, min(g), len(g)) for g in groups.values() for i in g)
    leads, texts = exact.hot_openings(spark.createDataFrame([("a", 1)] * 9 + [("b", k) for k in range(9)], "lead string, h long"),
                                      exact.Scratch(spark, "test"), 1)
    assert sorted(map(tuple, leads.collect())) == [("a", 3), ("b", 3)] and list(map(tuple, texts.collect())) == [("a", 1, 3)]


def test_exact_equals_sql(spark):
    same(exact.op7_exact_dedup(spark, SMALL), duck_dir(SMALL), exact.SQL)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_jaccard(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = classes(links, ids)
    return sorted((i, len(sets[i]), root[i]) for i in ids)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_edge_rows(spark, width, percent):
    rows = [r for r in edge_rows() if r[0] is not None]
    got = {tuple(r) for r in jaccard.ngram_jaccard_join(edge_docs(spark, rows), width=width, percent=percent).collect()}
    assert sorted(got) == brute_jaccard(dict((r[0], r[1]) for r in rows).items(), width, percent)


def test_jaccard_sets_are_picked_in_place(spark):
    """Only wanted sets are taken, and no shuffle moves texts or sets before."""
    rows = [(i % 50, f"{'Same words here again' if i % 2 else f'w{i % 7} b c d e f'} x{i % 10}") for i in range(100)] + [(None, "a b c d e"), (7, None), (8, " ")]
    texts = spark.createDataFrame(rows, "id long, t string")
    parts = [b for b in jaccard._hash_sets([pa.record_batch({"id": [r[0] for r in rows], "t": [r[1] for r in rows]})], 4)]
    ids = [int(v) for _, _, _, v in parts for v in v]
    least = {}
    for (i, t), node in zip(rows, ids):
        if t and t.strip():
            least[node] = i if least.get(node) is None else min(i, least[node])
    some = sorted(least)[::2]
    wanted = spark.createDataFrame([(n, least[n]) for n in some], "node long, id long")
    got = jaccard.set_arrays(texts, wanted, 4)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = [r.node for r in got.collect()]
    assert set(some) <= set(found) and len(set(found) - set(some)) <= 2
    picked = jaccard.arrays_of(wanted.select("node").limit(1), got)
    assert {r.node for r in wanted.select("node").limit(1).collect()} <= {r.node for r in picked.collect()}


def variants(seed, n, families, size):
    """Texts of a few families with a random number of edited words."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(4, size))] for _ in range(families)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(words) // 25)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        rows.append((i, " ".join(words + [f"t{i}"] * rng.randrange(2)), None, None, None))
    return rows


@pytest.mark.parametrize("seed,n,families,size,first", [(1, 260, 6, 300, 16), (2, 200, 40, 30, 1), (3, 300, 1, 400, 2)])
def test_jaccard_families(spark, seed, n, families, size, first, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "STAR", 8)
    monkeypatch.setattr(jaccard, "FIRST", first)
    monkeypatch.setattr(jaccard, "HELD", 20)
    rows = variants(seed, n, families, size)
    got = sorted(map(tuple, jaccard.ngram_jaccard_join(edge_docs(spark, rows), width=4, percent=85).collect()))
    assert got == brute_jaccard([r[:2] for r in rows], 4, 85)


def test_jaccard_tiles_find_every_linked_pair():
    rng = np.random.default_rng(5)
    bands = jaccard.Bands(85)
    for size in [1, 5, 6, 7, 8, 12, 13, 20, 33, 34, 55, 100, 300, 1000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            drop = int(15 * size // 100)
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop // 2:]], rng.integers(0, 2**64, drop - drop // 2, dtype=np.uint64))))
            if not jaccard.linked(a, b, 85) or np.array_equal(a, b):
                continue
            s, k = jaccard.tile_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), bands)
            assert set(k[s == 0].tolist()) & set(k[s == 1].tolist()), size


def test_jaccard_bitmap_never_hides_a_link():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 200), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.95], rng.integers(0, 2**64, rng.integers(0, 9), dtype=np.uint64))))
        if len(b) and jaccard.linked(a, b, 85):
            assert jaccard.compare_star(a, [b], 85) == [0]


def test_jaccard_empty_table(spark):
    assert jaccard.ngram_jaccard_join(edge_docs(spark, [])).count() == 0


def test_jaccard_equals_sql(spark):
    same(jaccard.op1_ngram_jaccard(spark, SMALL), duck_dir(SMALL), jaccard.SQL)


def test_components_of_chain_star_and_pairs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    want = classes(links, {x for e in links for x in e})
    assert len(got) == len(want)
    pairs = {(got[i], want[i]) for i in want}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def brute_suffix(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), runs, kept))
    return out


def suffix_rows(df):
    return sorted((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


def passages(seed, n):
    rng = random.Random(seed)
    words = [f"{rng.randrange(10**6):x}" for _ in range(300)]
    shared = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared)[rng.randrange(50):])
        rows.append((i * 3 - 40, rng.choice(["", "\x00\x00", "ab" * 90, "ü" * 70]).join(parts), None, None, None))
    return rows + [(900 + k, rows[k][1], None, None, None) for k in range(5)]


def test_suffix_edge_rows(spark):
    rows = [r for r in edge_rows() if r[0] is not None and r[0] != 12]
    assert suffix_rows(suffixes.suffix_dedup(edge_docs(spark, rows))) == brute_suffix([r[:2] for r in rows])


@pytest.mark.parametrize("split", [20_000, 4])
def test_suffix_passages(spark, split, monkeypatch):
    monkeypatch.setattr(suffixes, "SPLIT", split)
    rows = passages(8, 90)
    assert suffix_rows(suffixes.suffix_dedup(edge_docs(spark, rows))) == brute_suffix([r[:2] for r in rows])


def test_suffix_parts_of_one_beginning_are_sorted_apart():
    # one beginning in 40 parts of 50 rows, between two that are not split
    rows = [(b"a", 0)] * 30 + [(b"b", k) for k in range(40) for _ in range(50)] + [(b"c", 0)] * 70
    table = pa.table({"lead": [r[0] for r in rows], "salt": [r[1] for r in rows], "id": range(len(rows))})
    for size in (1, 33, 700, len(rows)):
        groups = [pa.Table.from_batches(g) for g in suffixes.sort_groups(table.to_batches(max_chunksize=size), 100)]
        assert pa.concat_tables(groups).equals(table)
        assert max(g.num_rows for g in groups) < 100 + 50
        parts = [set(zip(g["lead"].to_pylist(), g["salt"].to_pylist())) for g in groups]
        assert sum(map(len, parts)) == len(set().union(*parts))          # no part is cut


def test_suffix_shared_and_null_ids(spark):
    text = " ".join(str(k * 7919) for k in range(60))
    rows = [(1, text + " one", None, None, None), (1, text + " two", None, None, None), (1, text + " two", None, None, None), (None, text, None, None, None), (0, "short", None, None, None)]
    got = suffixes.suffix_dedup(edge_docs(spark, rows)).collect()
    assert len(got) == 5
    removed = {}
    for r in got:
        removed.setdefault(r["id"], []).append((r["n_bytes"], r["n_removed"]))
    assert removed[0] == [(5, 0)] and removed[None] == [(len(text), len(text))]
    whole = [n for n in removed[1] if n[1] == 0]
    assert len(removed[1]) == 3 and len(whole) in (1, 2)
    assert suffixes.suffix_dedup(edge_docs(spark, [])).count() == 0


def test_multikey_order_is_the_sorted_order():
    rng = np.random.default_rng(2)
    digits = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = suffixes.multikey_order(digits)
    assert [tuple(digits[i]) for i in order] == sorted(map(tuple, digits))


def vector_rows(seed, n, dim):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(8, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(8)] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 0.45, 2])
        rows.append((i, [float(x) for x in v * 10.0 ** rng.integers(-3, 4)]))
    return rows


def brute_vectors(rows, threshold):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.abs(v).max() for i, v in ok.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    ids = sorted(i for i, _ in rows)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = classes(links, ids)
    return sorted((i, n[i], root[i], root[i] == i) for i in ids)


@pytest.mark.parametrize("dim,tile", [(48, 64), (6, 16), (20, 4096)])
def test_vectors_brute_force(spark, dim, tile):
    rows = vector_rows(dim, 300, dim)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, []), (1004, [0.0] * dim), (1005, [float("nan")] * dim),
             (1006, [1.0, None] + [0.0] * (dim - 2)), (1007, [float("inf")] + [1.0] * (dim - 1)), (1008, [1.0, 2.0]), (1009, [2.0, 4.0]), (1010, [1e300] * dim), (1011, [1e-300] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "node", "n", "dim", "vec"):
        df = df.selectExpr("*", f"7 as {name}")
    assert sorted(map(tuple, vectors.near_vectors(df, tile=tile).collect())) == brute_vectors(rows, 0.9)


def test_vectors_empty_table_and_sql(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    same(vectors.op2_near_vectors(spark, SMALL), duck_dir(SMALL), vectors.SQL)


def test_vectors_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (5, [0.0, 1.0]), (None, None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by_id = {i: sorted(((r.n_links, r.component_id) for r in got if r.id == i), key=str) for i in (1, 5, None)}
    assert len(got) == 5 and by_id[1] == [(2, 1)] * 2 and by_id[5] == [(0, 5)]
    assert by_id[None] == [(0, None), (2, 1)]
