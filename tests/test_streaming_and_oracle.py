import datetime as dt
import os

import duckdb
import pytest


import __spark_entry__ as E
from tidewatch.operators import strikes as ST
from tidewatch.plans import standins as S
from tidewatch.streaming import streams as SS

from .conftest import SMALL


def test_strike_stream_equals_batch_replay(spark, scratch):
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for i, d in
            enumerate([40, 0, 10, 45, 80, 81, 200, 90])] + [(2, 100 + i, dt.datetime(2024, 3, 1)) for i in range(3)]
    df = spark.createDataFrame(rows, "u long, seq long, created timestamp_ntz")
    src = os.path.join(scratch, "strikes")
    # arrival order = sequence order: one file per micro-batch, written in order
    import time
    df.where("seq < 4").coalesce(1).write.parquet(src + "/a")
    time.sleep(1.1)
    df.where("seq >= 4").coalesce(1).write.parquet(src + "/b")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*/*.parquet")
    q = (SS.strike_stream(stream, "u", "created", "seq", 30).writeStream.format("memory")
         .queryName("strike_out").outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.seq, r.n_strikes) for r in spark.sql("select * from strike_out").collect()}
    want = {(r.seq, r.n_strikes) for r in ST.strikes_replay(df, "u", "created", "seq", 30).collect()}
    assert got == want


def test_evaluate_stream_writes_batch_results(spark, scratch):
    from tidewatch.sources.io import read_messages
    src = os.path.join(scratch, "msgs")
    S.messages(spark, SMALL).write.parquet(src)
    stream = read_messages(spark, src, streaming=True).select("message_id", "author_id", "jump_url", "content")
    out = os.path.join(scratch, "out")
    q = SS.evaluate_stream(stream, S.TEST_TERMS, S.TEST_PATTERNS, S.TEST_PII_RULES, S.synthetic_scorer,
                           out, os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = spark.read.parquet(out + "/decisions").select("message_id", "score", "reason")
    want = E.queries()["evaluate_messages"](spark, SMALL).select("message_id", "score", "reason")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


FAST = ["blocklist_match", "match_all_terms", "highlight_hit", "regex_match", "evaluate_messages",
        "abuse_strikes", "abuse_strikes_replay", "apply_edits", "confusion_matrix", "report_status",
        "resolve_link", "action_notifications", "strike_balance_replay", "load_terms"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents labels conversations events orders customer nation region").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)

    def norm(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)
                       for r in rows), key=repr)
    assert norm(sdf.columns, [tuple(r) for r in sdf.collect()]) == norm(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


def _dialog_inputs(spark, sf):
    from tidewatch.plans import catalog as C
    S.clear_shared()
    turns, guilds, chans, msgs = C.dm_world(spark, sf)
    return turns, guilds, chans, msgs


def test_sorted_dialog_pass_equals_brute_force(spark):
    from collections import defaultdict
    from tidewatch.operators import dialog as DG
    from .conftest import MEDIUM
    turns, guilds, chans, msgs = _dialog_inputs(spark, MEDIUM)
    prepared = DG.prepare_turns(turns, guilds, chans, msgs)
    by_author = defaultdict(list)
    for r in prepared.orderBy("author_id", "turn_seq").collect():
        by_author[r.author_id].append(r.asDict())
    want_r, want_e, seen, edits = [], [], set(), set()
    for a, recs in by_author.items():
        r, e, _ = DG.fold_resume(recs, None)
        want_r += [(x["author_id"], x["start_seq"], x["message_id"], x["abuse_type"]) for x in r]
        want_e += [tuple(x) for x in e]
        seen |= {x["abuse_type"] for x in r}
        edits |= {x[2:4] for x in e}
    assert seen == set(DG.REPORT_CATEGORIES.values()) and edits == set(DG.LIST_MENU.values())
    assert all(m >= S.ID_BASE for _, _, m, _ in want_r)
    got_r = [(r.author_id, r.start_seq, r.message_id, r.abuse_type)
             for r in DG.reports_from_turns(prepared).collect()]
    got_e = [tuple(r) for r in DG.list_edits_from_turns(prepared).collect()]
    assert sorted(got_r) == sorted(want_r) and len(want_r) > 0
    assert sorted(got_e) == sorted(want_e) and len(want_e) > 0


def test_dialog_stream_equals_batch(spark, scratch):
    import json
    from tidewatch.operators import dialog as DG
    from .conftest import MEDIUM
    turns, guilds, chans, msgs = _dialog_inputs(spark, MEDIUM)
    src = os.path.join(scratch, "turns")
    turns.write.parquet(src)
    stream = spark.readStream.schema(turns.schema).parquet(src)
    q = (SS.dialog_stream(stream, guilds, chans, msgs).writeStream.format("memory").queryName("dlg_out")
         .outputMode("append").option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.sql("select * from dlg_out").collect()
    got = sorted((p["author_id"], p["start_seq"], p["message_id"]) for p in
                 (json.loads(r.payload) for r in out if r.kind == "report"))
    batch = DG.reports_from_turns(DG.prepare_turns(turns, guilds, chans, msgs))
    want = sorted((r.author_id, r.start_seq, r.message_id) for r in batch.collect())
    assert got == want and len(want) > 0


def test_stream_rereads_lists_per_batch(spark, scratch):
    import time
    rows = [(1, "you idiot", 1, "u"), (2, "you moron", 1, "u")]
    df = spark.createDataFrame(rows, "message_id long, content string, author_id long, jump_url string")
    src = os.path.join(scratch, "m")
    df.where("message_id = 1").coalesce(1).write.parquet(src + "/a")
    time.sleep(1.1)
    df.where("message_id = 2").coalesce(1).write.parquet(src + "/b")
    lists = iter([["moron"], ["moron", "idiot"]])
    current = {"terms": None}

    def terms():
        current["terms"] = next(lists)
        return current["terms"]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*/*.parquet")
    out = os.path.join(scratch, "out")
    SS.evaluate_stream(stream, terms, [], [], None, out, os.path.join(scratch, "ck")).awaitTermination()
    got = {r.message_id: r.score for r in spark.read.parquet(out + "/decisions").collect()}
    # batch 1 ran with ["moron"] only (idiot not yet listed); batch 2 with both
    assert got == {1: 0.0, 2: 1.0}


def test_sorted_passes_carry_state_across_arrow_batches(spark):
    from tidewatch.operators import dialog as DG
    from .conftest import MEDIUM
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    o = spark.read.parquet(f"{MEDIUM}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    turns, guilds, chans, msgs = _dialog_inputs(spark, MEDIUM)
    prepared = DG.prepare_turns(turns, guilds, chans, msgs).checkpoint()

    def run():
        s = sorted((r.o_orderkey, r.n_strikes) for r in
                   ST.strikes_replay(o, "o_custkey", "o_orderdate", "o_orderkey", 365).collect())
        d = sorted((r.author_id, r.start_seq, r.message_id) for r in DG.reports_from_turns(prepared).collect())
        return s, d
    base = run()
    try:
        spark.conf.set(key, "3")               # users and authors span many batches
        small = run()
    finally:
        spark.conf.set(key, old)
    assert base == small and len(base[1]) > 0
