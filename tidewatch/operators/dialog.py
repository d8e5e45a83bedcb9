"""Guided direct-message dialogs replayed as data (O-F2, O-F3, O-F4, O-E7).

Link resolution is relational and runs first (joins against guilds,
channels and messages), so every turn carries small resolved fields:
``link_ok / link_reason / link_message_id / extra_ids / choice``.  The
per-author state machine then only looks those up.  It is sequential per
author: batch sorts each partition by (author, turn) and makes one pass
holding only the current author's open session; streams keep the same open
session as keyed state.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import HARASSMENT_CATEGORIES, IMMINENT_DANGER_CATEGORIES, REPORT_CATEGORIES
from ..functions.text import LINK_PATTERN, choice_number, parse_message_link, strip_ws
from .routing import CANCEL_KEYWORD, HELP_KEYWORD, LIST_KEYWORD, REPORT_KEYWORD

# Reasons a report link is refused.
LINK_UNREADABLE = "unreadable"
LINK_GUILD_UNKNOWN = "guild unknown"
LINK_CHANNEL_UNKNOWN = "channel unknown"
LINK_MESSAGE_UNKNOWN = "message unknown"


def resolve_link(turns: DataFrame, guilds: DataFrame, chans: DataFrame, msgs: DataFrame,
                 col: str = "content") -> DataFrame:
    """O-F2: first link in the text -> message id, or the first failing step.

    Guilds and channels are small aggregates, broadcast by adaptive
    execution from their measured size; the message lookup is a shuffled
    left join on (channel, message) id.
    """
    p = turns.withColumn("_l", parse_message_link(F.col(col)))
    g = guilds.select(F.col("guild_id").alias("_g")).distinct().withColumn("_g_ok", F.lit(True))
    c = (chans.select(F.col("guild_id").alias("_cg"), F.col("channel_id").alias("_c"))
         .distinct().withColumn("_c_ok", F.lit(True)))
    wanted = (p.where(F.col("_l.message_id").isNotNull())
               .select(F.col("_l.channel_id").alias("_mc"), F.col("_l.message_id").alias("_m")).distinct())
    m = _linked_messages(msgs, wanted).withColumn("_m_ok", F.lit(True))
    j = (p.join(g, F.col("_l.guild_id") == F.col("_g"), "left")
          .join(c, (F.col("_l.guild_id") == F.col("_cg")) & (F.col("_l.channel_id") == F.col("_c")), "left")
          .join(m, (F.col("_l.channel_id") == F.col("_mc")) & (F.col("_l.message_id") == F.col("_m")), "left"))
    reason = (F.when(~F.col("_l.matched"), F.lit(LINK_UNREADABLE))
              .when(F.col("_g_ok").isNull(), F.lit(LINK_GUILD_UNKNOWN))
              .when(F.col("_c_ok").isNull(), F.lit(LINK_CHANNEL_UNKNOWN))
              .when(F.col("_m_ok").isNull(), F.lit(LINK_MESSAGE_UNKNOWN)))
    return (j.withColumn("link_reason", reason)
             .withColumn("link_message_id", F.when(reason.isNull(), F.col("_l.message_id")))
             .drop("_l", "_g", "_g_ok", "_cg", "_c", "_c_ok", "_mc", "_m", "_m_ok"))


def _linked_messages(msgs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The few messages that links point at, as ``(_mc, _m)``.

    Only two id columns of the message table are read; adaptive execution
    broadcasts the linked ids if their measured size allows it.
    """
    m = msgs.select(F.col("channel_id").alias("_mc"), F.col("message_id").alias("_m"))
    if wanted.isStreaming:
        # in a stream the ids arrive per micro-batch: plain stream-static lookup
        return m
    return m.join(wanted, ["_mc", "_m"], "left_semi")


def explode_links(turns: DataFrame, key: list[str], col: str = "content") -> DataFrame:
    """O-B9: whitespace-separated tokens, each parsed as a link (order kept)."""
    toks = F.split(strip_ws(F.col(col)), r"\s+", -1)
    x = turns.select(*key, F.posexplode(toks).alias("tok_no", "tok"))
    return (x.where(F.col("tok").rlike(LINK_PATTERN))
             .select(*key, "tok_no", parse_message_link(F.col("tok")).alias("link")))


def resolve_links(turns: DataFrame, key: list[str], chans: DataFrame, msgs: DataFrame,
                  col: str = "content") -> DataFrame:
    """O-F3: the resolvable links of each text, failures silently dropped.

    Returns ``key + extra_ids array<bigint>`` in text order, duplicates kept.
    """
    x = explode_links(turns, key, col)
    c = chans.select(F.col("guild_id").alias("_cg"), F.col("channel_id").alias("_c")).distinct()
    wanted = x.select(F.col("link.channel_id").alias("_mc"), F.col("link.message_id").alias("_m")).distinct()
    m = _linked_messages(msgs, wanted)
    ok = (x.join(c, (F.col("link.guild_id") == F.col("_cg")) & (F.col("link.channel_id") == F.col("_c")))
           .join(m, (F.col("link.channel_id") == F.col("_mc")) & (F.col("link.message_id") == F.col("_m"))))
    return (ok.groupBy(*key)
              .agg(F.array_sort(F.collect_list(F.struct("tok_no", F.col("_m").alias("id")))).alias("_ids"))
              .select(*key, F.transform("_ids", lambda s: s["id"]).alias("extra_ids")))


def prepare_turns(turns: DataFrame, guilds: DataFrame, chans: DataFrame, msgs: DataFrame) -> DataFrame:
    """Turns with every relational lookup done: the fold's only input."""
    key = ["author_id", "turn_seq"]
    r = resolve_link(turns, guilds, chans, msgs)
    extra = resolve_links(turns, key, chans, msgs)
    return (r.join(extra, key, "left")
             .withColumn("extra_ids", F.coalesce("extra_ids", F.array().cast("array<bigint>")))
             .withColumn("choice", choice_number(F.col("content"), 7))
             .select("author_id", "turn_seq", "content", "link_reason", "link_message_id",
                     "extra_ids", "choice"))


# ---------------------------------------------------------------- fold ----

REPORT_SCHEMA = ("author_id long, start_seq long, end_seq long, message_id long, abuse_type string, "
                 "harassment_type string, multiple_harassers boolean, imminent_danger string, "
                 "other_details string, other_message_ids array<long>, safety_mode boolean, "
                 "block_requested boolean")
EDIT_SCHEMA = "author_id long, turn_seq long, list_kind string, op string, content string"
# List-dialog menu numbers -> (list, operation) for payload states.
LIST_MENU = {2: ("word", "add"), 3: ("word", "remove"), 5: ("regex", "add"), 6: ("regex", "remove")}



class Step(NamedTuple):
    """One question of a dialog: the answer it takes, the field it sets and
    the question that follows (by choice where ``after`` names one)."""
    answer: str                 # link | choice | text | links
    field: str
    then: str | None            # None: the dialog is complete
    values: dict | None = None  # choice -> value
    after: dict | None = None   # choice -> next question


_YES_NO = {1: True, 2: False}
# The report dialog: every question with its answers and successors.
REPORT_STEPS = {
    "message": Step("link", "message_id", "type"),
    "type": Step("choice", "abuse_type", "extras", REPORT_CATEGORIES, {1: "harassment", 5: "danger", 6: "details"}),
    "details": Step("text", "other_details", "extras"),
    "harassment": Step("choice", "harassment_type", "multiple", HARASSMENT_CATEGORIES),
    "multiple": Step("choice", "multiple_harassers", "extras", {k: k == 1 for k in range(1, 8)}),
    "danger": Step("choice", "imminent_danger", "extras", IMMINENT_DANGER_CATEGORIES),
    "extras": Step("links", "other_message_ids", "safety"),
    "safety": Step("choice", "safety_mode", "block", _YES_NO),
    "block": Step("choice", "block_requested", None, _YES_NO),
}
FIRST_STEP = "message"
EMPTY_REPORT = {"message_id": None, "abuse_type": None, "harassment_type": None, "multiple_harassers": None,
                "imminent_danger": None, "other_details": None, "other_message_ids": [], "safety_mode": False,
                "block_requested": False}


def _answer(step: Step, turn: dict):
    """(accepted, value) of a turn as the answer to a question."""
    if step.answer == "link":
        return turn["link_reason"] is None and turn["link_message_id"] is not None, turn["link_message_id"]
    if step.answer == "choice":
        return turn["choice"] in step.values, step.values.get(turn["choice"])
    return True, turn["content"] if step.answer == "text" else list(turn["extra_ids"])


def advance(session: dict | None, turn: dict) -> tuple[dict | None, dict | None, tuple | None]:
    """One turn of one author: (session after it, finished report, list edit).

    A session is ``{"list": None | menu number}`` or ``{"ask": question,
    "report": fields}``; None when no dialog is open.
    """
    content = turn["content"]
    if content == HELP_KEYWORD:
        return session, None, None            # answered, not consumed
    if session is None:
        if content.startswith(REPORT_KEYWORD):
            return {"ask": FIRST_STEP, "report": None}, None, None
        return ({"list": None} if content.startswith(LIST_KEYWORD) else None), None, None
    if content == CANCEL_KEYWORD:
        return None, None, None
    if "list" in session:
        if session["list"] is None:
            return {"list": turn["choice"] if turn["choice"] in LIST_MENU else None}, None, None
        edit = (turn["author_id"], turn["turn_seq"], *LIST_MENU[session["list"]], content)
        return {"list": None}, None, edit if content else None
    step = REPORT_STEPS[session["ask"]]
    accepted, value = _answer(step, turn)
    if not accepted:
        return session, None, None
    report = session["report"] or {"author_id": turn["author_id"], "start_seq": turn["turn_seq"], **EMPTY_REPORT}
    report = {**report, step.field: value}
    follow = (step.after or {}).get(turn["choice"], step.then)
    if follow is None:
        return None, {**report, "end_seq": turn["turn_seq"]}, None
    return {"ask": follow, "report": report}, None, None


def fold_resume(rows, session: dict | None) -> tuple[list, list, dict | None]:
    """All turns of one author in order, from an open session (if any)."""
    reports, edits = [], []
    for turn in rows:
        session, report, edit = advance(session, turn)
        if report:
            reports.append(report)
        if edit:
            edits.append(edit)
    return reports, edits, session


def turn_rows(batch: pa.RecordBatch) -> list[dict]:
    """Turns of an Arrow batch; ids stay 64-bit integers, nulls included."""
    rows = batch.to_pylist()
    for r in rows:
        r["content"] = r["content"] or ""
        r["extra_ids"] = r["extra_ids"] or []
    return rows


REPORT_ARROW = pa.schema([
    ("author_id", pa.int64()), ("start_seq", pa.int64()), ("end_seq", pa.int64()), ("message_id", pa.int64()),
    ("abuse_type", pa.string()), ("harassment_type", pa.string()), ("multiple_harassers", pa.bool_()),
    ("imminent_danger", pa.string()), ("other_details", pa.string()), ("other_message_ids", pa.list_(pa.int64())),
    ("safety_mode", pa.bool_()), ("block_requested", pa.bool_())])
EDIT_COLS = ["author_id", "turn_seq", "list_kind", "op", "content"]
EDIT_ARROW = pa.schema([("author_id", pa.int64()), ("turn_seq", pa.int64()), ("list_kind", pa.string()),
                        ("op", pa.string()), ("content", pa.string())])


def _fold_sorted(want: str):
    """One pass over a partition sorted by (author, turn): only the current
    author's open session is held, however long the author's history."""
    def fn(batches):
        author, session = object(), None
        for b in batches:
            reports, edits = [], []
            for turn in turn_rows(b):
                if turn["author_id"] != author:
                    author, session = turn["author_id"], None
                session, report, edit = advance(session, turn)
                if report:
                    reports.append(report)
                if edit:
                    edits.append(dict(zip(EDIT_COLS, edit)))
            yield pa.RecordBatch.from_pylist(reports if want == "reports" else edits,
                                             REPORT_ARROW if want == "reports" else EDIT_ARROW)
    return fn


def _sorted_turns(prepared: DataFrame) -> DataFrame:
    from ..session import ship_package
    ship_package(prepared.sparkSession)
    return prepared.repartition("author_id").sortWithinPartitions("author_id", "turn_seq")


def reports_from_turns(prepared: DataFrame) -> DataFrame:
    """O-F4: completed report rows (one per finished report dialog).

    One shuffle by author, a sort by turn inside each partition, then a
    single pass per partition over Arrow rows carrying the open session.
    """
    return _sorted_turns(prepared).mapInArrow(_fold_sorted("reports"), REPORT_SCHEMA)


def list_edits_from_turns(prepared: DataFrame) -> DataFrame:
    """O-E7: list edits entered through the list dialog (same pass)."""
    return _sorted_turns(prepared).mapInArrow(_fold_sorted("edits"), EDIT_SCHEMA)


def session_flags(prepared: DataFrame) -> DataFrame:
    """The turns with ``in_report_session`` and ``in_list_session`` as they
    stand when each turn arrives (what command routing needs)."""
    def fn(batches):
        author, session = object(), None
        for b in batches:
            flags = []
            for turn in turn_rows(b):
                if turn["author_id"] != author:
                    author, session = turn["author_id"], None
                flags.append((session is not None and "ask" in session, session is not None and "list" in session))
                session, _, _ = advance(session, turn)
            yield pa.RecordBatch.from_arrays(
                [b.column("author_id").cast(pa.int64()), b.column("turn_seq").cast(pa.int64()), b.column("content"),
                 pa.array([r for r, _ in flags], pa.bool_()), pa.array([x for _, x in flags], pa.bool_())],
                ["author_id", "turn_seq", "content", "in_report_session", "in_list_session"])
    schema = "author_id long, turn_seq long, content string, in_report_session boolean, in_list_session boolean"
    return _sorted_turns(prepared).mapInArrow(fn, schema)
