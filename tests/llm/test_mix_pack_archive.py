"""Mixing by SQL, packing and archives by round trip, and the pipeline."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from tests.llm.helpers import SMALL, duck, duck_dir, edge_docs, edge_rows, same
from tests.llm.test_duplicates import LOWER, brute_jaccard
from tidewatch.llm import mixing, packing, warc
from tidewatch.llm.common import Scratch, read_table


def mix_query(docs):
    return mixing.pareto_mix(docs).selectExpr("id as doc_id", "size", "source_size", "target", "taken")


def test_mix_equals_sql(spark):
    same(mixing.op5_mix_sources(spark, SMALL), duck_dir(SMALL), mixing.SQL)


def test_mix_edge_rows(spark):
    rows = [r for r in edge_rows() if r[0] != 12]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    same(mix_query(edge_docs(spark, rows)), duck({"documents": frame}), mixing.SQL)
    assert mixing.pareto_mix(edge_docs(spark, [])).count() == 0


def test_mix_of_empty_texts_and_repeated_rows(spark):
    rows = [(i, None, None, "abc"[i % 3], None) for i in range(9)]
    got = mixing.pareto_mix(edge_docs(spark, rows)).collect()
    assert len(got) == 9 and {(r["size"], r["taken"], r["target"]) for r in got} == {(0, 0, 0.0)}
    got = mixing.pareto_mix(edge_docs(spark)).where("id = 12").collect()
    assert len(got) == 2 and got[0] == got[1]


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([1, 20, 200, 3000]), None, rng.choice("aaaaaabcdefg"), None) for i in range(1500)]
    got = mixing.pareto_mix(edge_docs(spark, rows)).toPandas()
    again = mixing.pareto_mix(edge_docs(spark, rows)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(sums.taken - sums.target) <= 3000 / 2).all()      # half the largest document
    assert (got.taken <= 3 * got["size"]).all() and abs(sums.target.sum() - sums["size"].sum()) < 1


def test_mix_skips_a_document_that_does_not_fit(spark):
    # in every source one text holds a third of the words
    rng = random.Random(3)
    rows = [(k * 1000 + i, "w " * rng.randrange(5, 60), None, f"s{k:02d}", None) for k in range(12) for i in range(120)]
    for k in range(12):
        rows.append((k * 1000 + 999, "w " * (sum(len(r[1]) // 2 for r in rows if r[3] == f"s{k:02d}") // 2), None, f"s{k:02d}", None))
    docs = edge_docs(spark, rows)
    got = mixing.pareto_mix(docs).toPandas()
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert len(got) == len(rows) and (abs(sums.taken - sums.target) <= 60 / 2).all()      # half the largest of the small documents
    copies = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SMALL).collect())
    assert copies == {i: n for i, n in zip(got.id, got.copies) if n}


def test_mix_takes_what_a_walk_down_the_rank_takes(spark):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(0.7) * 3 % 5000), None, rng.choice(["a", "b", None, "d"]), None) for i in range(900)]
    rows += [(None, "w " * 7, None, "a", None), (None, "w " * 5, None, "a", None), (3, "w " * 40, None, "b", None)]
    got = mixing.pareto_mix(edge_docs(spark, rows)).collect()
    sources = collections.defaultdict(lambda: collections.defaultdict(int))
    copies, shape = {}, {}
    for r in got:
        sources[r["source"]][r["id"]] += r["size"]
        shape[r["source"]] = (r["target"], r["source_size"])
        assert copies.setdefault((r["source"], r["id"]), r["copies"]) == r["copies"]
    for source, units in sources.items():
        target, size = shape[source]
        whole = int(target // size)
        gap, want = target - whole * size, set()
        needed = {i for i in units if size - gap < units[i] <= gap}

        def rank(i):
            u = int(hashlib.md5(f"1:{'' if i is None else i}".encode()).hexdigest()[:13], 16)
            return i not in needed, u

        for i in sorted(units, key=rank):
            if units[i] <= gap:
                gap -= units[i]
                want.add(i)
        close = [(abs(units[i] - gap), rank(i), i) for i in units if i not in want and abs(units[i] - gap) < gap]
        want |= {min(close)[2]} if close else set()
        assert {i for i in units if units[i] and copies[source, i] > whole} == {i for i in want if units[i]}


def test_source_targets_match_resharing(spark):
    rng = random.Random(9)
    for _ in range(3):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 10, 1000, 10**6]) for k in range(rng.randrange(1, 9))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
        target, free, left = {}, set(sizes), float(sum(sizes.values()))
        while free:
            share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
            over = {s for s in free if share[s] > 3 * sizes[s]}
            for s in over or free:
                target[s] = 3.0 * sizes[s] if over else share[s]
            left -= sum(target[s] for s in over)
            free = free - over if over else set()
        assert all(abs(got[s] - target[s]) < 1e-6 * max(1, target[s]) for s in sizes)


def check_packing(rows, texts, capacity=2048):
    full = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bins = collections.defaultdict(list)
    seen = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["id"]].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for i, text in texts:
        ids = np.array(full.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in seen[i]})
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(ids) // capacity) and all(p[2] == capacity for p in parts[1:])
        at = 0
        for _, start, length, crc in parts:
            assert start == at and crc == zlib.crc32(ids[at:at + length].tobytes())
            at += length
        assert at == len(ids)
    return len(bins)


def test_packing_edge_rows(spark):
    rows = edge_rows() + [(50, "with <|endoftext|> inside", None, None, None)]
    got = packing.pack(edge_docs(spark, rows)).collect()
    check_packing(got, [r[:2] for r in rows])
    assert sum(r["id"] == 12 for r in got) == 2
    assert packing.pack(edge_docs(spark, [])).count() == 0


def test_packing_whole_table(spark):
    rows = packing.pack(read_table(spark, SMALL, "documents")).collect()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    n = check_packing(rows, texts)
    assert n <= 1.01 * sum(r["length"] for r in rows) / 2048 + 2


@pytest.mark.parametrize("seed", range(4))
def test_configurations_are_exact_and_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(5.5 + seed / 3, 1.2, 3000).astype(int), 1, 2048)
    count = dict(collections.Counter(sizes.tolist()))
    bins = packing.configurations(count)
    got = collections.Counter()
    for n, column in bins:
        assert n > 0 and sum(column) <= 2048
        for s in column:
            got[s] += n
    assert got == count
    assert sum(n for n, _ in bins) <= 1.02 * max(sizes.sum() / 2048, (sizes > 1024).sum()) + 2
    t = packing.places(bins)
    assert len(t["bin"]) == len(set(zip(t["length"], t["rank"])))


def test_knapsack_price_is_optimal():
    rng = np.random.default_rng(0)
    value = np.where(rng.random(41) < 0.3, rng.random(41), -np.inf)
    value[0] = -np.inf
    best, choice = packing.price(value, 40)
    plain = [0.0]
    for w in range(1, 41):
        plain.append(max([plain[-1]] + [plain[w - s] + value[s] for s in range(1, w + 1) if value[s] > 0]))
    assert np.allclose(best, plain)
    chosen = packing.fill(choice, 40)
    assert sum(chosen) <= 40 and np.isclose(sum(value[s] for s in chosen), best[40])


def test_warc_equals_sql(spark):
    same(warc.op10_warc(spark, SMALL), duck_dir(SMALL), warc.SQL)


PAGES = [(1, "http://a/", "x" * 100), (2, None, "x" * 100), (3, "http://b/\r\nEvil: 1", "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "u", ""), (7, "é", "é" * 50),
         (0, "z", "é" * 50), (8, "u", "line\r\n\r\nWARC/1.1\r\n" * 40), (9, "u", "long " * 400_000), (9, "u", "long " * 400_000), (None, "n", "x" * 100)]


def test_warc_edge_rows_and_seek(spark, scratch):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name in ("id", "payload", "sha", "part", "bundle"):
        df = df.selectExpr("*", f"1 as {name}")
    path = f"file://{scratch}/bundles"
    index = warc.write_warc(df, path).collect()
    assert len(index) == len(PAGES)
    got = warc.read_warc(spark, path, spark.createDataFrame(index)).collect()
    rows = collections.Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    first = {"x" * 100: "1", "é" * 50: "0"}
    want = collections.Counter()
    for i, _, html in PAGES:
        body, name = (html or "").encode(), "" if i is None else str(i)
        refers = first.get(html or "")
        refers = None if refers == name else refers
        want[name, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert rows == want
    for place in index:
        blob = open(f"{scratch}/bundles/{place['bundle']}", "rb").read()
        headers, body = warc.read_record(blob, place["frame"], place["offset"])
        assert headers["WARC-Record-ID"] == f"<urn:page:{'' if place['id'] is None else place['id']}>" and "Evil" not in headers


def test_warc_empty_table(spark, scratch):
    index = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{scratch}/none")
    assert index.count() == 0 and warc.read_warc(spark, f"file://{scratch}/none", index).count() == 0


def test_warc_bundles_are_zstandard_streams(spark, scratch):
    import io

    import zstandard
    writer = warc.BundleWriter()
    records = [warc.record_bytes(str(i), "u", b"p" * 90_000, "00", None) for i in range(9)]
    at = [writer.add(r) for r in records]
    blob = writer.finish()
    assert len({f for f, _ in at}) > 1
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True).read()
    assert plain == b"".join(records)


def test_pipeline_edge_rows(spark):
    docs, scratch, sizes = edge_docs(spark), Scratch(spark, "edge"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = scratch.put(stage(spark, docs, SMALL), name)
        assert name == "packing" or docs.columns == before
        sizes.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "mix_sources", "packing"]
    assert sizes[0] == len(edge_rows()) - 4
    docs = edge_docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.put(stage(spark, docs, SMALL), name)
        assert docs.count() == 0


def test_pipeline_keeps_documents_without_any_label(spark):
    docs = edge_docs(spark, [(r[0], r[1], None, *r[3:]) for r in edge_rows()])
    got = corpus_pipeline.identify_language(spark, docs, SMALL)
    assert got.columns == docs.columns and got.count() == len(edge_rows())


def test_pipeline_against_brute_force(spark):
    docs = read_table(spark, SMALL, "documents")
    scratch = Scratch(spark, "brute")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = scratch.put(stage(spark, docs, SMALL), name)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert len(kept[0]) >= 0.99 * read_table(spark, SMALL, "documents").count()
    best = {}
    for i, t in kept[0].items():
        best[t.translate(LOWER)] = max(best.get(t.translate(LOWER), i), i)
    assert set(kept[1]) == set(best.values())
    classes = brute_jaccard(sorted(kept[1].items()), 5, 80)
    assert set(kept[2]) == {i for i, _, c in classes if i == c}
    copies = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, SMALL).collect())
    mixed = {r["id"]: r["copies"] for r in mixing.pareto_mix(docs).collect()}
    assert copies == {i: n for i, n in mixed.items() if n}
    whole = corpus_pipeline.run(spark, SMALL).collect()
    pieces = collections.Counter((r["doc_id"], r["piece"]) for r in whole)
    assert {i: n for (i, k), n in pieces.items() if k == 0} == dict(copies)
