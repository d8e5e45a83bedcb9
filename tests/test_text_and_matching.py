from pyspark.sql import functions as F

from tidewatch.functions import text as TX
from tidewatch.functions.render import hit_reason, REASON_TERM
from tidewatch.operators import matching as M
from tidewatch.plans import standins as S

from .conftest import SMALL


def test_normalize_strip_fold_lower(spark):
    df = spark.createDataFrame([("   Grüße, Ærøskøbing IDIÖT \n",)], "content string")
    r = TX.with_normalized(df).first()
    assert r.stripped == "Grüße, Ærøskøbing IDIÖT"
    assert r.folded == "Grusse, AEroskobing IDIOT"
    assert r.lowered == "grusse, aeroskobing idiot"


def test_split_lines_like_python(spark):
    from tidewatch.operators.lists import split_lines
    cases = ["a\nb\n", "a\r\nb", "", "a\n\nb", "x y", "only"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [r[0] for r in df.select(split_lines(F.col("c"))).collect()]
    assert got == [c.splitlines() for c in cases]


def test_parse_link_overflow_and_absent(spark):
    df = spark.createDataFrame([("x /1/2/3 y /4/5/6",), ("/99999999999999999999/1/2",), ("no link",)], "c string")
    rows = df.select(TX.parse_message_link(F.col("c")).alias("l")).select("l.*").collect()
    assert tuple(rows[0]) == (True, 1, 2, 3)
    assert rows[1].matched and rows[1].guild_id is None
    assert not rows[2].matched


def test_choice_rules(spark):
    df = spark.createDataFrame([(" 3 ",), ("7",), ("²",), ("0",), ("x",), ("12",)], "c string")
    got = [r[0] for r in df.select(TX.choice_number(F.col("c"), 7)).collect()]
    assert got == [3, 7, None, None, None, None]


def test_first_term_hit_order_and_blank_terms(spark):
    terms = M.terms_frame(spark, ["  Idiot ", "idio", "", "an idiot", "   "])
    assert sorted(r.term for r in terms.collect()) == ["an idiot", "idio", "idiot"]
    df = spark.createDataFrame([(1, "you are an idiot"), (2, "nothing")], "message_id long, lowered string")
    m = M.match_terms(df, terms, "lowered").orderBy("message_id").collect()
    # earliest start wins: "an idiot" starts before "idio"/"idiot"
    assert m[0].term_hit.item == "an idiot" and m[0].term_hit.start == 8
    assert m[1].term_hit is None


def test_longest_wins_at_same_start(spark):
    df = spark.createDataFrame([(1, "idiotic")], "message_id long, lowered string")
    hit = M.match_terms(df, ["idio", "idiot"], "lowered").first().term_hit
    assert (hit.item, hit.start, hit.end) == ("idiot", 0, 5)


def test_highlight_uses_folded_offsets_on_original(spark):
    # "ß" folds to "ss": offsets from the folded text drift on the original
    df = spark.createDataFrame([(1, "Große idiot")], "message_id long, content string")
    n = TX.with_normalized(df)
    m = M.match_terms(n, ["idiot"]).select(hit_reason(REASON_TERM, F.col("term_hit"), F.col("stripped"))).first()[0]
    assert m == 'contains blocked word or expression: `idiot` at "Große i`diot`"'


def brute_hits(text, terms):
    return {(t, text.find(t), text.find(t) + len(t)) for t in terms if t in text}


def test_term_hits_equal_brute_force(spark, monkeypatch):
    msgs = TX.with_normalized(S.messages(spark, SMALL)).select("message_id", "lowered")
    texts = {r.message_id: r.lowered for r in msgs.collect()}
    terms = S.TEST_TERMS + ["an", "of the", "a", "t", "ä", "x" * 300]  + [max(texts.values(), key=len)[40:340]]
    clean = {t.strip().lower() for t in terms if t.strip()}
    want = {(i, *h) for i, t in texts.items() for h in brute_hits(t, clean)}
    first = {i: min(((s, -len(t), t) for t, s, _ in brute_hits(x, clean)), default=None) for i, x in texts.items()}
    for block, table in ((100_000, 4_096), (3, 0)):      # a larger table goes through the index
        monkeypatch.setattr(M, "TERM_BLOCK", block)
        monkeypatch.setattr(M, "SMALL_TABLE", table)
        for given in (terms, spark.createDataFrame([(t,) for t in terms], "term string")):
            assert {tuple(r) for r in M.term_hits(msgs, given).collect()} == want
        hits = {r.message_id: r.term_hit for r in M.match_terms(msgs, terms).collect()}
        assert {i: h and (h.start, h.start - h.end, h.item) for i, h in hits.items()} == first


def test_terms_of_any_length_and_number(spark):
    text = "the quick brown fox " * 40
    df = spark.createDataFrame([(1, text + "é"), (2, ""), (3, None)], "message_id long, lowered string")
    many = [f"absent{i}" for i in range(12_000)] + ["é", "ox", text.strip()[:699]]
    hits = {r.term: r.start for r in M.term_hits(df, many).collect()}
    assert hits == {"é": len(text), "ox": 17, text.strip()[:699]: 0}
    got = {r.message_id: r.term_hit for r in M.match_terms(df, []).collect()}
    assert set(got.values()) == {None}


def test_term_index_equals_automaton(spark, monkeypatch):
    import random
    rng = random.Random(8)
    alphabet = "abcä é日"
    texts = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 30, 90, 400]))) for _ in range(300)] + ["ab" * 30_000 + " needle in a long text indeed " + "é" * 10, None, ""]
    df = spark.createDataFrame([(i // 2 if i > 250 else i, t, "x") for i, t in enumerate(texts)], "message_id long, lowered string, term string")
    pool = [t for t in texts if t]
    terms = {"a", "ä", "日", "ab", "é日", "needle in a long text indeed", "zzz", "z" * 50, "ab" * 40}
    while len(terms) < 400:
        t = rng.choice(pool)
        lo = rng.randrange(len(t))
        terms.add(t[lo:lo + rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 23, 24, 25, 40, 90])].strip() or "q")
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    for whole_word in (False, True):
        want = sorted(map(str, M.match_terms(df, sorted(terms), whole_word=whole_word).collect()))
        every = sorted(map(str, M.term_hits(df, sorted(terms), whole_word=whole_word).collect()))
        monkeypatch.setattr(M, "SMALL_TABLE", 0)
        assert sorted(map(str, M.match_terms(df, table, whole_word=whole_word).collect())) == want
        assert sorted(map(str, M.term_hits(df, table, whole_word=whole_word).collect())) == every
        monkeypatch.undo()


def test_first_hit_of_table_lists_no_later_hits(spark, monkeypatch):
    """Terms that occur everywhere give work up to the first hit only."""
    from tidewatch.operators import term_index as TI
    written = []

    def counted(df, name):
        out = stored(df, name)
        if name == "first-hits":
            written.append(out.count())
        return out

    def never(*args):
        raise AssertionError("every hit of every text would be listed")
    stored = TI.stored
    monkeypatch.setattr(TI, "stored", counted)
    monkeypatch.setattr(TI, "candidate_terms", never)
    body = "".join(chr(97 + (i * i // 7) % 26) for i in range(6000))
    early = [(i, "é" * (i % 3) + body[i:i + 3000]) for i in range(40)]
    late = [(100, "é" * 5 + "0" * 300 + body), (101, "0" * 4000 + body[:50]), (101, "0" * 4000 + body[:50]), (None, "0" * 20 + body[-9:]), (102, "0" * 9000)]
    df = spark.createDataFrame(early + late, "message_id long, lowered string")
    terms = sorted({body[i:i + n] for i in range(0, 5990) for n in (1, 3, 6, 9)})
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    got = TI.match_indexed(df, table, "lowered", "hit")
    assert sorted(map(str, got.collect())) == sorted(map(str, M.match_terms(df, terms, out="hit").collect()))
    assert written[0] == 40 and sum(written) == 43


def test_more_terms_than_a_bitmap_holds(spark, monkeypatch):
    """Terms come in parts, whose bitmaps never fill up; pieces come a bounded lot at a time."""
    import random
    import numpy as np
    import pyarrow as pa
    from tidewatch.functions import grams as G
    from tidewatch.operators import term_index as TI
    rng, full, joins = random.Random(3), [], []
    texts = ["".join(rng.choices("abcdeé 日", k=rng.choice([1, 7, 40, 300]))) for _ in range(60)] + [None, "", "é" * 400 + "abc"]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "message_id long, lowered string")
    terms = {"".join(rng.choices("abcdefgé", k=rng.choice([4, 6, 8, 9, 17, 40]))) for _ in range(3000)}
    terms |= {t[k:k + n] for t in texts[:40] if t for k, n in ((5, 9), (9, 16), (20, 70))} - {""}
    terms = {t.strip().lower() for t in terms if t.strip()}

    def filled(context, value):
        full.append(np.unpackbits(value[1]).mean())
        return broadcast(context, value)

    def kept(df, name):
        out = stored(df, name)
        if name == "first-hits":
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi"))
        return out
    context, stored = type(spark.sparkContext), TI.stored
    broadcast = context.broadcast
    monkeypatch.setattr(TI, "stored", kept)
    monkeypatch.setattr(TI, "PIECE_BITS", 1 << 15)
    table = spark.createDataFrame([(t,) for t in sorted(terms)], "term string")
    for whole_word in (False, True):
        want = sorted(map(str, M.match_terms(df, sorted(terms), out="hit", whole_word=whole_word).collect()))
        with monkeypatch.context() as own:
            own.setattr(context, "broadcast", filled)
            assert sorted(map(str, TI.match_indexed(df, table, "lowered", "hit", whole_word).collect())) == want
    assert len(full) > 2 and max(full) < 0.2 and set(joins) == {1}

    monkeypatch.setattr(G, "STRETCH", 1 << 12)
    body, offsets = G.bytes_of(pa.array(["ab" * 50_000, None, "é" + "ab" * 9], pa.string()))
    sizes, every = np.array([1, 2, 5, 100]), np.full(1 << 12, 255, np.uint8)
    lots = [(row, char, G.cut_out(body, at, size).to_pylist()) for row, char, at, size in G.text_pieces(body, offsets, 0, None, sizes, every)]
    assert max(sum(map(len, x[2])) for x in lots) <= 1 << 12
    got = [(r, c, p) for x in lots for r, c, p in zip(x[0].tolist(), x[1].tolist(), x[2])]
    assert len(got) == len(set(got)) == sum(100_000 - n + 1 for n in (1, 2, 5, 100)) + (18 + 1) + (17 + 1) + (14 + 1)
    assert all(p == (b"ab" * 51)[c % 2:c % 2 + len(p)] for r, c, p in got if r == 0)


def test_large_term_table_is_not_held_in_memory(spark, monkeypatch):
    frame, levels = type(spark.range(1)), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *level: levels.append(level) or persist(df, *level))
    monkeypatch.setattr(M, "SMALL_TABLE", 2)
    for n, want in ((2, ["t0", "t1"]), (3, None)):
        assert M.small_terms(spark, spark.createDataFrame([(f"T{i} ",) for i in range(n)], "term string")) == want
    assert [[x.useDisk and not x.useMemory for x in level] for level in levels] == [[True], [True]]


def test_term_index_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL_TABLE", -1)
    df = spark.createDataFrame([(1, "some text"), (None, "term here")], "message_id long, lowered string")
    none = spark.createDataFrame([], "term string")
    assert [r.term_hit for r in M.match_terms(df, none).collect()] == [None, None]
    one = spark.createDataFrame([("Term ",), (None,), (" ",)], "term string")
    assert sorted((r.message_id is None, r.term_hit and r.term_hit.start) for r in M.match_terms(df, one).collect()) == [(False, None), (True, 0)]
    assert M.match_terms(df.limit(0), one).count() == 0


def test_patterns_validated(spark):
    import pytest
    with pytest.raises(ValueError):
        M.validate_patterns(spark, ["ok[0-9]", "foo(bar"])


def test_unmatched_matches_each_text_once(spark, monkeypatch):
    """The folded text is computed once a row, and no place of a pattern hit."""
    monkeypatch.setattr(M, "PATTERN_BLOCK", 2)
    rows = [(1, "fine"), (2, "an idiöt"), (3, "x 123 y"), (4, None), (5, "mail a@b"), (6, ""), (6, "zz"), (None, "fine too")]
    df = TX.with_normalized(spark.createDataFrame(rows, "message_id long, content string"))
    out = M.unmatched(df, ["idiot"], ["[0-9]+", "a@b", "q{3}", "z+"])
    assert out.columns == df.columns
    assert sorted((r[0] or 0, r[1] or "") for r in out.collect()) == [(0, "fine too"), (1, "fine"), (4, ""), (6, "")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_instr" not in plan and "regexp_substr" not in plan
    assert plan.count("translate(") == 1


def test_whole_word_and_folded_terms(spark):
    df = spark.createDataFrame([(1, "stupidity is not stupid"), (2, "idiot!"), (3, "große dummheit")],
                               "message_id long, lowered string")
    sub = {r.message_id: r.term_hit for r in M.match_terms(df, ["stupid", "idiot"]).collect()}
    ww = {r.message_id: r.term_hit for r in M.match_terms(df, ["stupid", "idiot"], whole_word=True).collect()}
    assert sub[1].start == 0 and ww[1].start == 17 and ww[2].item == "idiot"
    # an accented term never matches folded text unless terms are folded too
    plain = {r.message_id: r.term_hit for r in M.match_terms(df.withColumn(
        "lowered", F.regexp_replace("lowered", "ß", "ss")), ["Große"]).collect()}
    folded = {r.message_id: r.term_hit for r in M.match_terms(df.withColumn(
        "lowered", F.regexp_replace("lowered", "ß", "ss")), ["Große"], fold=True).collect()}
    assert plain[3] is None and folded[3].item == "grosse"
    t = M.load_terms(spark.createDataFrame([(" Größe ",)], "term string"), fold=True)
    assert [r.term for r in t.collect()] == ["grosse"]


def test_sources_and_sinks_roundtrip(spark, scratch):
    import os
    from tidewatch.sources import io as IO
    m = S.messages(spark, SMALL)
    p = os.path.join(scratch, "messages")
    m.write.parquet(p)
    back = IO.read_messages(spark, p)
    assert back.count() == m.count() and back.schema["created_at"].dataType.simpleString() == "timestamp_ntz"
    tp = os.path.join(scratch, "terms.txt")
    with open(tp, "w") as f:
        f.write("Idiot\n\n  moron \nidiot\n")
    assert sorted(r.term for r in IO.read_terms(spark, tp).collect()) == ["idiot", "moron"]
    out = os.path.join(scratch, "decisions")
    IO.write_decisions(back.select("message_id").limit(3), out)
    IO.write_decisions(back.select("message_id").limit(2), out)
    assert spark.read.parquet(out).count() == 5


def test_many_patterns_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "call 555 now"), (2, "nothing"), (3, "id77 or call")], "message_id long, folded string")
    patterns = [f"zz{i}" for i in range(30)] + ["[0-9]{3}", "call", "id[0-9]+"]
    whole = [r.regex_hit for r in M.match_regexes(df, patterns).orderBy("message_id").collect()]
    monkeypatch.setattr(M, "PATTERN_BLOCK", 4)
    assert [r.regex_hit for r in M.match_regexes(df, patterns).orderBy("message_id").collect()] == whole
    assert [h and h.item for h in whole] == ["call", None, "id[0-9]+"]


def test_evaluate_cleans_terms(spark):
    from tidewatch.operators import decide as D
    df = spark.createDataFrame([(1, "you IDIOT"), (2, "hello")], "message_id long, content string")
    for terms in (["", "  ", "Idiot "], spark.createDataFrame([("",), (" Idiot",)], "term string")):
        got = {r.message_id: (r.score, r.stage) for r in D.evaluate(df, terms, [], []).collect()}
        assert got == {1: (1.0, "term"), 2: (0.0, "none")}


def test_folding_of_evasions(spark):
    cases = {"i\u0301di\u0308ot": "idiot", "ｉｄｉｏｔ": "idiot", "𝓲𝓭𝓲𝓸𝓽": "idiot", "ⓘⓓiot": "idiot", "идиот": "idiot", "ΙΔΙΟΤ": "IDIOT",
             "Ёж и щука": "Ezh i shchuka", "ﬁne": "fine", "日本": "日本", "Ærø": "AEro", "naïve 😀": "naive 😀"}
    df = spark.createDataFrame([(k,) for k in cases], "content string")
    got = {r.content: r.folded for r in TX.with_normalized(df).collect()}
    assert got == cases
    from tidewatch.functions.folding import fold_python
    assert {k: fold_python(k) for k in cases} == cases


def test_sinks_append_and_stream(spark, scratch):
    import os
    from tidewatch.sources import io as IO
    for write, name in ((IO.write_reports, "reports"), (IO.write_notifications, "notices"), (IO.write_decisions, "decisions")):
        out = os.path.join(scratch, name)
        rows = spark.range(5).select(F.col("id").alias("report_id"), (F.col("id") % 2).alias("day"))
        write(rows, out)
        write(rows.limit(2), out)
        assert spark.read.parquet(out).count() == 7
        src, live = os.path.join(scratch, name + "_in"), os.path.join(scratch, name + "_live")
        rows.write.parquet(src)
        q = write(spark.readStream.schema(rows.schema).parquet(src), live, os.path.join(scratch, name + "_ck"))
        q.processAllAvailable()
        q.stop()
        assert sorted(r.report_id for r in spark.read.parquet(live).collect()) == [0, 1, 2, 3, 4]
