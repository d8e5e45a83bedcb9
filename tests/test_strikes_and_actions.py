import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import strikes as ST
from tidewatch.plans import catalog as C

from .conftest import MEDIUM


def _events(spark, dates, user=1):
    rows = [(user, i, dt.datetime.fromisoformat(d)) for i, d in enumerate(dates)]
    return spark.createDataFrame(rows, "u long, seq long, created timestamp_ntz")


def _counts(df):
    return [r.n_strikes for r in df.orderBy("seq").collect()]


def test_replay_head_only_eviction(spark):
    e = _events(spark, ["2024-01-01", "2024-01-31", "2024-01-15"])
    assert _counts(ST.strikes_replay(e, "u", "created", "seq", 30)) == [1, 1, 2]
    e = _events(spark, ["2024-02-10", "2024-01-01", "2024-03-01"])
    # the expired Jan 1 strike sits behind a live head and still counts
    assert _counts(ST.strikes_replay(e, "u", "created", "seq", 30))[-1] == 3
    assert _counts(ST.strikes_window(e, "u", "created", "seq", 30))[-1] == 2


def test_exactly_horizon_old_is_expired_and_ties_count_in_order(spark):
    e = _events(spark, ["2024-01-01", "2024-01-31", "2024-01-31", "2024-02-01"])
    for mode in ("window", "replay"):
        assert _counts(ST.strikes(e, "u", "created", "seq", 30, mode)) == [1, 1, 2, 3]


def test_window_equals_replay_in_creation_order_and_known_totals(spark):
    o = spark.read.parquet(f"{MEDIUM}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    # action order = creation order (ties by key): both modes must agree
    ranked = o.withColumn("seq", F.row_number().over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("o_orderdate", "o_orderkey")))
    w = ST.strikes_window(ranked, "o_custkey", "o_orderdate", "seq", 365)
    r = ST.strikes_replay(ranked, "o_custkey", "o_orderdate", "seq", 365)
    agg = w.agg(F.max("n_strikes"), F.sum("n_strikes")).first()
    assert tuple(agg) == (9, 36097)
    diff = w.select("seq", "n_strikes").exceptAll(r.select("seq", "n_strikes"))
    assert diff.count() == 0


def test_time_buckets_match_plain_window(spark):
    from pyspark.sql import Window
    e = spark.read.parquet(f"{MEDIUM}/events.parquet").select("event_id", "user_id", "ts")
    got = ST.strikes_window(e, "user_id", "ts", "event_id", 7).select("event_id", "n_strikes")
    h = 7 * ST.DAY_US
    t = ST._micros("ts")
    plain = e.withColumn("t", t).withColumn(
        "n_strikes", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-(h - 1), 0)))
    assert got.exceptAll(plain.select("event_id", "n_strikes")).count() == 0
    agg = got.agg(F.max("n_strikes"), F.sum("n_strikes")).first()
    assert agg[0] > 0


def test_ladders(spark):
    df = spark.createDataFrame([(1, "❗"), (2, "‼️"), (2, "❗"), (3, "‼️")], "n int, e string")
    got = [r[0] for r in df.select(ST.abuse_ladder(F.col("n"), F.col("e"))).collect()]
    assert got == ["warned", "slowed", "warned", "banned"]


def test_report_status_and_notices_run(spark):
    st = C.QUERIES["report_status"](spark, MEDIUM)
    assert st.count() > 0
    n = C.QUERIES["action_notifications"](spark, MEDIUM)
    assert n.where(F.col("text").isNull()).count() == 0


def test_hot_user_is_split_and_exact(spark):
    from pyspark.sql import Window
    o = spark.read.parquet(f"{MEDIUM}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    # one customer owns a third of all strike events
    hot = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")))
    ranked = hot.withColumn("seq", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")))
    w = ST.strikes_window(ranked, "o_custkey", "o_orderdate", "seq", 365)
    r = ST.strikes_replay(ranked, "o_custkey", "o_orderdate", "seq", 365)
    assert w.select("seq", "n_strikes").exceptAll(r.select("seq", "n_strikes")).count() == 0
    h = 365 * ST.DAY_US
    buckets = (hot.where("o_custkey = 0").select(F.floor(ST._micros("o_orderdate") / h).alias("b"))
               .distinct().count())
    assert buckets >= 5          # the hot user's window work spans >= 5 partitions


def test_status_and_notice_quirks(spark):
    import datetime as dt
    from tidewatch.operators import actions as AC
    from tidewatch.functions import render as R
    t = dt.datetime(2024, 1, 1)
    # (seq, report, abuser, reporter, is_auto, created, emoji)
    rows = [(1, "R1", 5, 9, False, t, "‼️"), (2, "R2", 5, 9, False, t + dt.timedelta(days=1), "‼️"),
            (3, "R3", 6, 8, False, t, "❔"), (4, "R4", 6, 8, False, t + dt.timedelta(days=1), "❔"),
            (5, "R5", 6, 8, False, t + dt.timedelta(days=2), "❔"), (6, "R6", 7, None, True, t, "❔")]
    corr = spark.createDataFrame(rows, "action_seq long, report_id string, abuser_id long, reporter_id long, "
                                       "is_auto boolean, report_created_at timestamp_ntz, emoji string")
    corr = (corr.withColumn("jump_url", F.lit("u")).withColumn("content", F.lit("c"))
                .withColumn("abuse_type", F.lit("Spam")))
    struck = AC.with_strikes(corr)
    st = {r.report_id: r for r in AC.report_status(struck).collect()}
    assert st["R2"].strike and not st["R2"].slow_mode          # "slowed" never sets the flag (Q10)
    assert st["R4"].false_report_strike and not st["R5"].false_report_strike  # third: restricted (Q11)
    assert not st["R6"].false_report_strike                     # auto report: ignored
    notes = {(r.action_seq, r.recipient_role): r.text for r in AC.notifications(struck).collect()}
    assert "has been slowed down for 2 strikes" in notes[(2, "abuser")]
    assert notes[(2, "reporter")] == "Your report R2 has been resolved. The abuser has been placed on slow mode."
    assert notes[(5, "reporter")].startswith("Your report R5 has been resolved and classified as a malicious")
    assert "You have reached three strikes for false reports." in notes[(5, "reporter")]
    assert not any(k[0] == 6 for k in notes)                      # nothing sent for ❔ on auto report
    assert (3, "abuser") not in notes                             # no abuser notice for ❔


def test_replay_balance_evicts_only_expired_heads(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "u long")
    e = _events(spark, ["2024-02-10", "2024-01-01", "2024-03-01"])          # user 1, out of order
    e = e.unionByName(_events(spark, ["2024-01-01"], user=2))
    got = {r.u: r.n for r in ST.strike_balance_replay(users, e, "u", "created", "seq", "2024-03-15 00:00:00",
                                                      30, "n").collect()}
    # user 1: list after replay is [Feb 10, Jan 1, Mar 1]; at Mar 15 the head (Feb 10, 34 days)
    # is evicted, then Jan 1 is the head and also expired, then Mar 1 is live -> 1
    assert got == {1: 1, 2: 0, 3: 0}
    got2 = {r.u: r.n for r in ST.strike_balance_replay(users, e, "u", "created", "seq", "2024-03-05 00:00:00",
                                                       30, "n").collect()}
    # at Mar 5 the head (Feb 10, 24 days) is live, so the expired Jan 1 behind it survives -> 3
    assert got2[1] == 3


def test_followers_boundary_and_repeated_strikes(spark):
    import datetime as dt
    from tidewatch.operators import reports as RE
    reps = spark.createDataFrame([("a", "u5000"), ("b", "u5001"), ("c", "nobody")],
                                 "report_id string, author_name string")
    acc = spark.createDataFrame([("u5000", 5000), ("u5001", 5001)], "user_name string, followers long")
    got = {r.report_id: (r.large_account, r.strike_emoji) for r in RE.account_size(reps, acc).collect()}
    assert got == {"a": (False, "❗"), "b": (True, "‼️"), "c": (False, "❗")}   # strictly > 5000
    # the same report struck twice appends twice (no dedup)
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, 0, t), (1, 1, t)], "u long, seq long, created timestamp_ntz")
    for mode in ("window", "replay"):
        assert [r.n_strikes for r in ST.strikes(e, "u", "created", "seq", 365, mode).orderBy("seq").collect()] == [1, 2]


def test_command_routing_precedence(spark):
    from tidewatch.operators import routing as RT
    df = spark.createDataFrame(
        [("help", True, False), ("report x", False, True), ("list", False, False), ("reporting", False, False),
         ("blocklist", False, False), ("searching", False, False), ("hello", False, False)],
        "content string, in_report_session boolean, in_list_session boolean")
    got = [r.command for r in RT.classify_command(df).collect()]
    assert got == ["help", "list_session", "list", "report", "blocklist", "search", "ignore"]


def head_only(rows, h):
    """The strike list itself: rows (key, seq, micros) -> {seq: count}."""
    lists, out = {}, {}
    for key, seq, t in sorted(rows, key=lambda r: r[1]):
        if key is None:
            out[seq] = None
            continue
        live = lists.setdefault(key, [])
        while live and t - live[0] >= h:
            live.pop(0)
        live.append(t)
        out[seq] = len(live)
    return out


def test_replay_out_of_order_large_ids_and_null_keys(spark):
    import random
    rng = random.Random(3)
    big = 2**60
    rows = [(rng.choice([big + 1, big + 2, 7, None]), big + i, rng.randrange(0, 900) * ST.DAY_US) for i in range(400)]
    df = spark.createDataFrame(rows, "u long, seq long, us long").selectExpr("u", "seq", "timestamp_micros(us) as at", "'text' as note")
    got = ST.strikes_replay(df, "u", "at", "seq", 30)
    assert got.columns == ["u", "seq", "at", "note", "n_strikes"]
    assert {r.seq: r.n_strikes for r in got.collect()} == head_only(rows, 30 * ST.DAY_US)
    assert {(r.u, r.seq) for r in got.collect()} == {(u, s) for u, s, _ in rows}
    users = spark.createDataFrame([(big + 1,), (big + 2,), (5,)], "u long")
    balance = {r.u: r.n for r in ST.strike_balance_replay(users, df, "u", "at", "seq", "1972-06-01 00:00:00", 30, "n").collect()}
    as_of = 882 * ST.DAY_US
    want = {5: 0}
    for u in (big + 1, big + 2):
        live = []
        for k, s, t in sorted(rows, key=lambda r: r[1]):
            if k == u:
                while live and t - live[0] >= 30 * ST.DAY_US:
                    live.pop(0)
                live.append(t)
        while live and as_of - live[0] >= 30 * ST.DAY_US:
            live.pop(0)
        want[u] = len(live)
    assert balance == want


def test_handling_order_counts_not_report_order(spark):
    rows = [(1, 1, "2024-06-01"), (1, 2, "2023-05-01"), (1, 3, "2024-07-01")]
    df = spark.createDataFrame(rows, "u long, seq long, d string").selectExpr("u", "seq", "cast(d as timestamp) as at")
    assert [r.n_strikes for r in ST.strikes(df, "u", "at", "seq", 365).orderBy("seq").collect()] == [1, 2, 3]


def test_one_user_with_many_strikes(spark):
    import time
    n = 300_000
    df = spark.range(n).selectExpr("1L as u", "id as seq", "timestamp_micros(id * 60000000) as at")
    for mode in ("window", "replay"):
        start = time.time()
        top = ST.strikes(df, "u", "at", "seq", 30, mode).agg(F.max("n_strikes"), F.count("*")).first()
        assert tuple(top) == (30 * 24 * 60, n) and time.time() - start < 60


def test_both_kinds_in_one_pass(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, 5, "a", 0), (2, 5, "b", 40), (3, 5, "a", 40), (4, 5, "a", 20), (5, None, "a", 1), (6, 5, "x", 1)],
                               "seq long, u long, e string, day int").withColumn("at", F.expr("timestamp_micros(day * 86400000000L)"))
    kinds = {"abuse": (F.col("e") == "a", F.col("u"), 365), "false": (F.col("e") == "b", F.col("u"), 30)}
    for mode in ("replay", "window"):
        got = {r.seq: (r.strike_kind, r.n_strikes) for r in ST.multi_horizon_strikes(df, kinds, "seq", "at", mode=mode).collect()}
        late = 3 if mode == "replay" else 2
        assert got == {1: ("abuse", 1), 2: ("false", 1), 3: ("abuse", 2 if mode == "replay" else 3), 4: ("abuse", late), 5: (None, None), 6: (None, None)}


def _fold(rows, horizon):
    """Counts by literal head-only eviction; rows (user, seq, time)."""
    lists, out = {}, []
    for user, seq, t in sorted(rows, key=lambda r: (r[1], r[2])):
        own = lists.setdefault(user, [])
        while own and t - own[0] >= horizon:
            own.pop(0)
        own.append(t)
        out.append((user, seq, t, len(own)))
    return sorted(out)


def test_replay_equals_fold_on_any_arrival_order(spark, monkeypatch):
    import random
    monkeypatch.setattr(ST, "BLOCKS", 7)
    rng = random.Random(3)
    start, day = dt.datetime(2020, 1, 1), dt.timedelta(days=1)
    rows, base = [], 1 << 60
    for user in range(12):
        n, spread, drift = rng.choice([(1, 5, 0), (40, 30, 1), (120, 400, 0), (200, 15, 2), (90, 1, 0)])
        at = 0
        for _ in range(n):
            at += rng.choice([0, drift, drift * 40])
            rows.append((user, base + rng.randrange(4000) * rng.choice([1, 1_000_003]), start + (at + rng.randrange(spread + 1)) * day))
    rows += [(1, rows[0][1], rows[0][2])] * 2 + [(0, 5, start + 3 * day)] * 3        # repeated rows
    df = spark.createDataFrame([*rows, (None, 1, start), (3, 2, None)], "u long, seq long, created timestamp_ntz")
    got = ST.strikes_replay(df, "u", "created", "seq", 30).collect()
    assert sorted((r.u, r.seq, r.created, r.n_strikes) for r in got if r.n_strikes) == _fold(rows, 30 * day)
    assert sorted(str(r.u) for r in got if r.n_strikes is None) == ["3", "None"]
    assert ST.strikes_replay(df.limit(0), "u", "created", "seq", 30).count() == 0
    # a look-up evicts like a strike at its time
    users = spark.createDataFrame([(u,) for u in range(14)], "u long")
    for as_of in ("2019-06-01 00:00:00", "2020-01-20 00:00:00", "2030-01-01 00:00:00"):
        left = {r.u: r.n for r in ST.strike_balance_replay(users, df, "u", "created", "seq", as_of, 30, "n").collect()}
        t = dt.datetime.fromisoformat(as_of)
        for u in range(14):
            mine = [(u, s, x) for v, s, x in rows if v == u]
            asked = _fold([*mine, (u, 1 << 62, t)], 30 * day)
            assert left[u] == (max(asked, key=lambda r: r[1])[3] - 1 if mine else 0), (u, as_of)


def test_repeated_sequence_numbers_keep_their_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 7, "a", t), (2, 7, "a", t + dt.timedelta(days=1)), (2, 7, "b", t + dt.timedelta(days=1)), (1, 7, "a", t), (1, 8, "a", t), (None, 9, "a", t)]
    df = spark.createDataFrame(rows, "seq long, who long, kind string, at timestamp_ntz")
    kinds = {"a": (F.col("kind") == "a", F.col("who"), 30), "b": (F.col("kind") == "b", F.col("who"), 30)}
    for mode in ("window", "replay"):
        got = sorted((r.seq or 0, r.who, r.kind, r.n_strikes) for r in ST.multi_horizon_strikes(df, kinds, "seq", "at", mode=mode).collect())
        assert got[1:] == [(1, 7, "a", 2), (1, 7, "a", 2), (1, 8, "a", 1), (2, 7, "a", 3), (2, 7, "b", 1)] and len(got) == 6, mode


def test_hot_user_without_gaps_is_many_tasks(spark):
    # one user, a strike a minute, out of order by up to a day: no gap of a horizon anywhere
    n = 200_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("u"), F.col("id").alias("seq"), F.timestamp_add(
        "MINUTE", F.col("id") - F.pmod(F.xxhash64("id"), F.lit(1440)), F.lit("2024-01-01").cast("timestamp")).cast("timestamp_ntz").alias("created"))
    order, _ = ST._edges(df.withColumn("_t", ST._micros("created")).withColumn("_h", F.lit(30 * ST.DAY_US)), "seq")
    assert len(order) > 200
    got = [r.n_strikes for r in ST.strikes_replay(df, "u", "created", "seq", 30).orderBy("seq").collect()]
    times = [r[0] for r in df.orderBy("seq").select(ST._micros("created")).collect()]
    from collections import deque
    live, want = deque(), []
    for t in times:
        while live and t - live[0] >= 30 * ST.DAY_US:
            live.popleft()
        live.append(t)
        want.append(len(live))
    assert got == want
