from pyspark.sql import functions as F

from tidewatch.operators import decide as D
from tidewatch.operators import dialog as DG
from tidewatch.operators import evaluate as EV
from tidewatch.operators import lists as L


def _msgs(spark, rows):
    return spark.createDataFrame(rows, "message_id long, content string, author_id long, jump_url string")


def _scorer(scores: dict, chat: dict):
    def fn(df):
        sp = df.sparkSession
        s = sp.createDataFrame([(k, v, chat.get(k)) for k, v in scores.items()],
                               "message_id long, attr_scores map<string,double>, chat_content string")
        return df.join(s, "message_id", "left")
    return fn


def test_cascade_order_thresholds_and_fail_open(spark):
    msgs = _msgs(spark, [(1, "you idiot 4111111111111111", 1, "u"), (2, "card 4111111111111111", 1, "u"),
                         (3, "He lives at 12 Oak Street.", 1, "u"), (4, "hello", 1, "u"),
                         (5, "hello", 1, "u"), (6, "hello", 1, "u"), (7, "hello", 1, "u")])
    scorer = _scorer({4: {"TOXICITY": 0.5, "SPAM": 0.71}, 5: {"TOXICITY": 0.9}, 6: None, 7: {"THREAT": 0.81}},
                     {4: "Yes.", 5: "Yes", 6: None, 7: " Yes"})
    d = {r.message_id: r for r in D.evaluate(msgs, ["idiot"], ["[0-9]{16}"],
                                             [r"[0-9]{1,5} [A-Z][a-z]+ Street"], scorer).collect()}
    assert (d[1].score, d[1].stage) == (1.0, "term")
    assert (d[2].score, d[2].stage) == (1.0, "regex")
    assert d[2].reason.startswith("contains blocked regex `[0-9]{16}` at \"card `4111")
    assert (d[3].score, d[3].reason) == (1.0, "contains pii: home street")
    # TOXICITY equal to its threshold does not flag; SPAM above 0.7 does
    assert (d[4].score, d[4].attribute) == (1.0, "SPAM")
    assert (d[5].score, d[5].attribute) == (1.0, "TOXICITY")
    assert (d[6].score, d[6].reason) == (0.0, "N/A")          # failed calls: fail-open
    assert (d[7].score, d[7].chat_flag) == (0.5, False)        # " Yes" is not a yes
    fmt = {r.message_id: r.evaluation for r in D.format_evaluation(
        D.evaluate(msgs, ["idiot"], [], [], scorer)).collect()}
    assert fmt[7] == "Evaluated: 'hello': 0.5, reason: post has been flagged by perspective and a report was sent\n"
    assert fmt[6].endswith(": 0, reason: N/A")


def test_python_scorer_only_sees_undecided_rows(spark, tmp_path):
    msgs = _msgs(spark, [(1, "idiot", 1, "u"), (2, "fine", 1, "u")])
    seen = []

    def scorer(df):
        seen.append(sorted(r.message_id for r in df.select("message_id").collect()))
        return df.withColumn("attr_scores", F.lit(None).cast("map<string,double>")) \
                 .withColumn("chat_content", F.lit("Yes"))
    out = {r.message_id: r.score for r in D.evaluate(msgs, ["idiot"], [], [], scorer, python_scorer=True).collect()}
    assert out == {1: 1.0, 2: 0.5} and seen[0] == [2]


def test_labeled_lines_split_at_last_comma(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text("hello, world,not_cyberbullying\r\nyou suck,age\nno comma here\n")
    got = [tuple(r) for r in EV.read_labeled_posts(spark, str(p)).collect()]
    assert got == [("hello, world", "not_cyberbullying", False), ("you suck", "age", True)]


def _turns(spark, texts, author=7):
    return spark.createDataFrame([(author, i, t, None, None, [], None) for i, t in enumerate(texts)],
                                 "author_id long, turn_seq long, content string, link_reason string, "
                                 "link_message_id long, extra_ids array<long>, choice int")


def _prep(spark, texts, link_ok=(), extras=None):
    from tidewatch.functions.text import choice_number
    t = _turns(spark, texts)
    t = t.withColumn("choice", choice_number(F.col("content"), 7))
    t = t.withColumn("link_message_id", F.when(F.col("turn_seq").isin(list(link_ok) or [-1]), F.lit(555)))
    t = t.withColumn("link_reason", F.when(F.col("link_message_id").isNull(), F.lit("unreadable")))
    if extras:
        t = t.withColumn("extra_ids", F.when(F.col("turn_seq") == extras[0], F.array(*[F.lit(x) for x in extras[1]]))
                         .otherwise(F.col("extra_ids")))
    return t


def test_report_dialog_happy_path_with_help_and_retry(spark):
    texts = ["report", "garbage", "help", "https://x/1/2/555", "1", "3", "7", "links", "1", "1"]
    prep = _prep(spark, texts, link_ok=[3], extras=(7, [11, 12]))
    r = DG.reports_from_turns(prep).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.message_id, r.abuse_type, r.harassment_type) == (555, "Harassment", "Hate Speech")
    assert r.multiple_harassers is False                    # choice 7 means "no"
    assert list(r.other_message_ids) == [11, 12] and r.safety_mode and r.block_requested


def test_report_dialog_cancel_and_other_details(spark):
    texts = ["report", "/1/2/555", "cancel", "report me", "/1/2/555", "6", "skip", "none", "2", "2"]
    prep = _prep(spark, texts, link_ok=[1, 4])
    r = DG.reports_from_turns(prep).collect()
    assert len(r) == 1 and r[0].other_details == "skip" and r[0].abuse_type == "Other"
    assert r[0].start_seq == 4


def test_list_dialog_and_edit_statuses(spark):
    texts = ["blocklist", "2", "Jerk\nidiot\n", "3", "nobody", "1", "cancel", "2", "late"]
    prep = _prep(spark, texts)
    eds = [tuple(r) for r in DG.list_edits_from_turns(prep).orderBy("turn_seq").collect()]
    assert [(e[2], e[3], e[4]) for e in eds] == [("word", "add", "Jerk\nidiot\n"), ("word", "remove", "nobody")]
    log = spark.createDataFrame(
        [(1, None, "word", "add", "Jerk\nidiot\n"), (2, None, "word", "remove", "nobody\njerk"),
         (3, None, "word", "add", " \nJERK")],
        "edit_seq long, edited_at timestamp_ntz, list_kind string, op string, content string")
    st = {(r.edit_seq, r.line_no): r.status for r in L.apply_edits(log, ["idiot"]).collect()}
    assert st[(1, 0)] == "added" and st[(1, 1)] == "already"
    assert st[(2, 0)] == "missing" and st[(2, 1)] == "removed"
    assert st[(3, 0)] == "invalid" and st[(3, 1)] == "added"
    cur = sorted(r.item for r in L.current_list(log, ["idiot"]).collect())
    assert cur == ["idiot", "jerk"]


def test_search_reply_details_and_guards(spark):
    from tidewatch.operators import reports as RE
    rid = "0123abcd-0000-4000-8000-00000000abcd"
    rep = spark.createDataFrame(
        [(rid, 7, "2024-01-02 03:04:05", "alice", "hi", "u", "bob", "Harassment", None, "Hate Speech",
          False, None, True, ["alice"])],
        "report_id string, reporter_id long, ts string, author_name string, content string, jump_url string, "
        "reporter string, abuse_type string, other_details string, harassment_type string, "
        "multiple_harassers boolean, imminent_danger string, safety_mode boolean, block_user array<string>"
    ).withColumn("report_created_at", F.col("ts").cast("timestamp_ntz"))
    status = spark.createDataFrame([(rid, True, False)], "report_id string, deleted boolean, strike boolean")
    req = spark.createDataFrame([(7, f"search {rid}"), (8, f"search {rid}"), (7, "search bad"), (7, "search")],
                                "author_id long, content string")
    got = {(r.author_id, r.content): r.reply for r in RE.search_reports(req, rep, status).collect()}
    details = got[(7, f"search {rid}")]
    assert details.startswith(f"Report {rid} at time 2024-01-02 03:04:05:\n\tReported message:\n\talice: \"hi\"")
    assert "\t\tHarassment Type: Hate Speech\n\t\tMultiple Harassers: False\n" in details
    assert "\tHas the sender been blocked: True\n\tHas the message been deleted: True\n" in details
    assert got[(8, f"search {rid}")] == RE.SEARCH_INVALID
    assert got[(7, "search bad")] is None
    assert got[(7, "search")] == RE.SEARCH_USAGE


def test_invalid_patterns_in_edit_log(spark):
    log = spark.createDataFrame(
        [(1, None, "regex", "add", "[0-9]{3}\nfoo(bar"), (2, None, "regex", "add", "foo(bar")],
        "edit_seq long, edited_at timestamp_ntz, list_kind string, op string, content string")
    st = {(r.edit_seq, r.line_no): r.status for r in L.apply_edits(log, check_patterns=True).collect()}
    assert st == {(1, 0): "added", (1, 1): "invalid", (2, 0): "invalid"}
    assert [r.item for r in L.current_list(log, check_patterns=True).collect()] == ["[0-9]{3}"]


def test_two_level_lag_and_lead_across_blocks(spark, monkeypatch):
    from tidewatch.plans import standins as S
    from .conftest import MEDIUM
    S.clear_shared()
    edits = S.list_edits(spark, MEDIUM)

    def snapshot():
        st = {(r.edit_seq, r.line_no): r.status for r in L.apply_edits(edits, S.TEST_TERMS).collect()}
        vs = sorted((r.list_kind, r.item, str(r.valid_from), str(r.valid_to))
                    for r in L.versions(edits, S.TEST_TERMS).collect())
        return st, vs
    one_block = snapshot()
    monkeypatch.setattr(L, "BLOCK", 7)       # every item spans hundreds of blocks
    many_blocks = snapshot()
    assert one_block == many_blocks and len(one_block[0]) > 10000


def test_header_option_and_empty_list_views(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text("tweet_text,cyberbullying_type\nhello,not_cyberbullying\n")
    assert [tuple(r) for r in EV.read_labeled_posts(spark, str(p)).collect()] == [
        ("tweet_text", "cyberbullying_type", True), ("hello", "not_cyberbullying", False)]   # parity: header read
    assert [tuple(r) for r in EV.read_labeled_posts(spark, str(p), header=True).collect()] == [
        ("hello", "not_cyberbullying", False)]
    cur = spark.createDataFrame([("word", "b"), ("word", "a")], "list_kind string, item string")
    views = {r.list_kind: r.view for r in L.render_list(cur).collect()}
    assert views["word"] == "The list of blocked words are:\na,\nb"
    # the regex view tests its own list for emptiness (Q7)
    assert views["regex"] == "The list of blocked regex expressions are:\nThere are currently no regex expressions blocked."


def test_header_option_skips_first_lines_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\nx,age\ntext,label\n")
    (tmp_path / "b.csv").write_text("text,label\n \"q, \\ y,not_cyberbullying\n")
    got = sorted(tuple(r) for r in EV.read_labeled_posts(spark, str(tmp_path), header=True).collect())
    assert got == [(' "q, \\ y', "not_cyberbullying", False), ("text", "label", True), ("x", "age", True)]
    assert EV.read_labeled_posts(spark, str(tmp_path)).count() == 5


def test_multiline_labelled_posts(spark, tmp_path):
    (tmp_path / "m.csv").write_text('post,label\n"two\nlines, ""quoted""",age\nplain,not_cyberbullying\n')
    got = sorted(tuple(r) for r in EV.read_labeled_posts(spark, str(tmp_path), header=True, multiline=True).collect())
    assert got == [("plain", "not_cyberbullying", False), ('two\nlines, "quoted"', "age", True)]


def test_removal_without_time_ends_its_own_version(spark):
    log = spark.createDataFrame(
        [(1, "2024-01-01", "word", "add", "bad"), (2, None, "word", "remove", "bad"), (2_500_000, "2025-01-01", "word", "remove", "bad")],
        "edit_seq long, at string, list_kind string, op string, content string").withColumn("edited_at", F.col("at").cast("timestamp_ntz"))
    got = [(str(r.valid_from), r.valid_to) for r in L.versions(log.drop("at")).collect()]
    assert got == [("2024-01-01 00:00:00", None)]


def test_list_as_of_matches_the_texts_once(spark):
    msgs = spark.createDataFrame([(1, "a jerk", "2024-01-02 00:00:00")], "message_id long, lowered string, t string")
    msgs = msgs.select("message_id", "lowered", F.col("t").cast("timestamp_ntz").alias("created_at"))
    edits = spark.createDataFrame([(1, "2024-01-01 00:00:00", "word", "add", "jerk")], "edit_seq long, t string, list_kind string, op string, content string")
    edits = edits.withColumn("edited_at", F.col("t").cast("timestamp_ntz")).drop("t")
    out = L.list_as_of(msgs, L.list_changes(edits))
    assert [tuple(r) for r in out.collect()] == [(1, "jerk")]
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()


def test_list_as_of_across_blocks_and_ties(spark):
    log = spark.createDataFrame(
        [(1, "2024-01-05 10:00:00", "word", "add", "bad"), (2, "2024-01-09 10:00:00", "word", "remove", "bad"),
         (3, "2024-01-09 10:00:00", "word", "add", "Bad"), (4, "2024-02-01 00:00:00", "word", "remove", "bad"), (5, None, "word", "add", "old")],
        "edit_seq long, at string, list_kind string, op string, content string").withColumn("edited_at", F.col("at").cast("timestamp_ntz"))
    times = ["2024-01-05 09:59:59", "2024-01-05 10:00:00", "2024-01-09 10:00:00", "2024-01-31 23:00:00", "2024-02-01 00:00:00"]
    msgs = spark.createDataFrame([(i, t, "so bad and old") for i, t in enumerate(times)], "message_id long, t string, lowered string")
    msgs = msgs.select("message_id", "lowered", F.col("t").cast("timestamp_ntz").alias("created_at"))
    got = sorted(tuple(r) for r in L.list_as_of(msgs, L.list_changes(log.drop("at"))).collect())
    assert got == [(0, "old"), (1, "bad"), (1, "old"), (2, "bad"), (2, "old"), (3, "bad"), (3, "old"), (4, "old")]


def test_pairs_and_running_totals_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(EV, "RUN_BLOCK", 7)
    posts = spark.range(300).select(F.col("id").alias("post_id"), (F.col("id") % 3 == 0).alias("is_positive"), (F.col("id") % 5 == 0).alias("p"))
    pairs = EV.balanced_pairs(posts, None, EV.hash_key("post_id", 1), carry=["p"]).orderBy("pair_idx").collect()
    assert [r.pair_idx for r in pairs] == list(range(1, 101))
    assert all(r.pos_id % 3 == 0 and r.neg_id % 3 for r in pairs)
    few = EV.balanced_pairs(posts, 9, EV.hash_key("post_id", 1)).orderBy("pair_idx").collect()
    assert [(r.pos_id, r.neg_id) for r in few] == [(r.pos_id, r.neg_id) for r in pairs[:9]]
    preds = spark.createDataFrame([(0, r.pair_idx, r.pos_p, r.neg_p) for r in pairs], "variant int, pair_idx long, pos_pred boolean, neg_pred boolean")
    got = {r.pair_idx: (r.tp, r.tn, r.fp, r.fn) for r in EV.running_confusion(preds, 50).collect()}
    assert set(got) == {25, 50, 75, 100}
    for k, v in got.items():
        tp, fp = sum(r.pos_p for r in pairs[:k]), sum(r.neg_p for r in pairs[:k])
        assert v == (tp, k - fp, fp, k - tp)


def test_word_scorer_prefers_abusive_words(spark):
    from tidewatch.operators import scorer as SC
    posts = spark.createDataFrame([("you fool fool", True), ("fool again", True), ("a fine day", False), ("fine words", False), (None, None)], "post string, y boolean")
    w = SC.fit_word_weights(posts, "post", "y")
    texts = spark.createDataFrame([(1, "such a FOOL"), (2, "a fine thing"), (3, "unseen"), (4, None)], "message_id long, content string")
    got = {r.message_id: r.score for r in SC.score_texts(texts, w, "message_id", "content").collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == 0.5
    dec = {r.message_id: r.score for r in D.evaluate(texts, [], [], [], scorer=SC.word_scorer(w)).collect()}
    assert dec == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}
