"""Classifiers by held-out accuracy, token counts by brute force."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex

from pyspark.sql import functions as F

from tests.llm.helpers import edge_docs, edge_rows
from tidewatch.llm import counts, language, quality
from tidewatch.llm.common import read_table, text_chunks

MEDIUM = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in language.op3_language_id(spark, MEDIUM).collect()}
    truth = {r["doc_id"]: r["lang"] for r in read_table(spark, MEDIUM, "documents").collect()}
    assert set(got) == set(truth)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.98


def test_language_edge_rows(spark):
    docs = edge_docs(spark)
    model = language.train_language_model(docs)
    got = language.language_id(docs, model).collect()
    assert len(got) == len(edge_rows())
    by = {r["id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 11))
    assert by[10]["lang_pred"] in model.langs
    none = language.language_id(docs, None).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language.train_language_model(edge_docs(spark, [])) is None
    assert language.language_id(edge_docs(spark, []), model).count() == 0


def test_language_survives_tables_of_numbers(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language.train_language_model(docs)
    longer = docs.where("lang is not null and length(text) between 1500 and 4000").select("doc_id", "lang", F.concat(
        "text", F.lit(" "), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: (i * 7919 % 100_003).cast("string")))).alias("text"))
    before = {r["id"]: r["lang_pred"] for r in language.language_id(docs, model).collect()}
    got = language.language_id(longer, model).collect()
    assert len(got) > 40 and all(r["lang_pred"] == before[r["id"]] for r in got)
    assert np.mean([r["score"] > 0.9 for r in got]) > 0.95


def test_language_sample_takes_copies_once(spark):
    rows = [(i, "same text in every row", "en") for i in range(50)] + [(99, "anderer Text", "de"), (100, "12345", "fr")]
    model = language.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    assert language.train_language_model(spark.createDataFrame([(1, "123", "fr")], "doc_id long, text string, lang string")) is None


def test_language_blocks_of_windows_equal_one_pass():
    model = language.ByteNet(["a", "b"])
    raw = np.frombuffer(("the quick brown fox " * 900).encode(), np.uint8)
    offs = np.array([0, 7, 7, 9000, len(raw)])
    tables = model.tables()
    whole = np.zeros((4, 2))
    x, doc = language.windows(raw, offs)
    np.add.at(whole, doc, model.probs(x, tables))
    parts = np.zeros((4, 2))
    for x, doc in language.window_blocks(raw, offs, 1024):
        np.add.at(parts, doc, model.probs(x, tables))
    assert np.allclose(whole, parts, atol=1e-5)


def test_language_tables_equal_the_filters():
    model = language.ByteNet(["a", "b", "c"])
    x, _ = language.windows(np.frombuffer(b"some words of text" * 40, np.uint8), np.array([0, 720]))
    emb = model.p["embed"][x]
    pooled = []
    for w in language.WIDTHS:
        cols = np.concatenate([emb[:, j:j + language.WINDOW] for j in range(w)], axis=2)
        pooled.append((cols @ model.p[f"filter{w}"]).max(axis=1) + model.p[f"bias{w}"])
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ model.p["out"] + model.p["out_bias"]
    z = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(z, model.probs(x, model.tables()), atol=1e-4)


def test_quality_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in quality.op4_quality(spark, MEDIUM).collect()}
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, MEDIUM, "labels").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    good = [got[i]["score"] for i in held if labels[i]]
    bad = [got[i]["score"] for i in held if not labels[i]]
    assert np.mean([[a > b for a in good] for b in bad]) > 0.95


def test_quality_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (7, 1), (99, 1), (None, 0), (1, 1)], "doc_id long, quality int")
    model = quality.train_quality_model(docs, labels, "quality")
    got = quality.quality_score(docs, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    twelve = [r["score"] for r in got if r["id"] == 12]
    assert len(twelve) == 2 and twelve[0] == twelve[1]
    assert quality.train_quality_model(edge_docs(spark, []), labels, "quality") is None
    assert {r["score"] for r in quality.quality_score(docs, None).collect()} == {0.5}
    assert quality.quality_score(edge_docs(spark, []), model).count() == 0


def test_quality_margin_equals_all_pairs():
    rng = np.random.default_rng(3)
    fm = quality.FactorisationMachine()
    fm.w = rng.normal(size=quality.FEATURES)
    f = np.array([4, 9, 77, 1000, 5, 9])
    x = rng.normal(size=6)
    got = fm.margin(f, x, np.array([0, 4, 6]))
    for k, (lo, hi) in enumerate([(0, 4), (4, 6)]):
        pairs = sum(fm.v[f[i]] @ fm.v[f[j]] * x[i] * x[j] for i in range(lo, hi) for j in range(i + 1, hi))
        assert math.isclose(got[k], fm.bias + (fm.w[f[lo:hi]] * x[lo:hi]).sum() + pairs, rel_tol=1e-9)


def test_quality_features_do_not_depend_on_the_batch():
    texts = ["One two two.\nLine!\nLine!", None, "", "\n\n", "UPPER 123 ###", "é" * 50, "a\tb\x0bc"]
    chars = np.arange(7, dtype=float)
    lo, hi, data, offs = next(text_chunks(pa.array(texts)))
    f, x, r = quality.features(data, offs, chars)
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        g, y, _ = quality.features(raw, np.array([0, len(raw)]), chars[i:i + 1])
        assert sorted(zip(f[r[i]:r[i + 1]], np.round(x[r[i]:r[i + 1]], 9))) == sorted(zip(g, np.round(y, 9)))


def brute_tokens(token, pieces):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for start in range(end):
            p = pieces.get(token[start:end])
            if p is not None:
                s, k = p + best[start][0], best[start][1] + 1
                if s > best[end][0] or (s == best[end][0] and k < best[end][1]):
                    best[end] = (s, k)
    return best[-1][1]


def test_token_counts_brute_force():
    pieces = counts.load_vocabulary(public_tokenizers.path(counts.VOCABULARY))
    trie = counts.PrefixTrie(pieces, limit=500)
    rng = random.Random(4)
    tokens = [rng.choice(["", " "]) + "".join(rng.choice("theionandsä1 ") for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    tokens += tokens[:50] + ["a" * 400, " " * 300]
    for t in tokens:
        assert trie.count(t.encode()) == brute_tokens(t.encode(), pieces)


def test_token_counts_query(spark):
    pieces = counts.load_vocabulary(public_tokenizers.path(counts.VOCABULARY))
    find = regex.compile(public_tokenizers.PATTERN).findall
    rows = [r for r in edge_rows() if r[0] not in (10, 14)]
    got = sorted(map(str, map(tuple, counts.token_counts(edge_docs(spark, rows)).collect())))
    want = []
    for i, t, *_ in rows:
        parts = find(t or "")
        want.append(str((i, len((t or "").encode()), len(parts), sum(brute_tokens(p.encode(), pieces) for p in parts))))
    assert got == sorted(want)
    assert counts.token_counts(edge_docs(spark, [])).count() == 0


def test_token_counts_bounds_change_nothing():
    pieces = counts.load_vocabulary(public_tokenizers.path(counts.VOCABULARY))
    find = regex.compile(public_tokenizers.PATTERN).findall
    texts = [r[1] or "" for r in edge_rows()]
    small = counts.TerminalCounts(counts.PrefixTrie(pieces, 50), 10)
    large = counts.TerminalCounts(counts.PrefixTrie(pieces))
    assert [small.total(find(t[:3000])) for t in texts] == [large.total(find(t[:3000])) for t in texts]


@pytest.mark.parametrize("limit", [1, 64, 1 << 21])
def test_text_chunks_are_whole(limit):
    texts = pa.array(["abc", None, "", "x" * 500, "é", None]).slice(1)
    seen = {}
    for lo, hi, data, offs in text_chunks(texts, limit):
        for i in range(lo, hi):
            seen[i] = data[offs[i - lo]:offs[i - lo + 1]].tobytes().decode()
    assert [seen[i] for i in range(5)] == ["", "", "x" * 500, "é", ""]
