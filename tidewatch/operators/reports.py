"""Report records: creation, fan-out, block sets, rendering, lookups
(O-F1, O-F5..F8, O-F10..F13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Account size limit and the strike reaction offered per size.
LARGE_ACCOUNT_FOLLOWERS = 5000
DEFAULT_FOLLOWERS = 1
STRIKE_SMALL, STRIKE_LARGE = "❗", "‼️"
UUID_PATTERN = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def uuid_like(*cols) -> Column:
    """Deterministic report id in UUID text form (replays give the same id)."""
    h = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]), 256)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4),
                       h.substr(21, 12))


def new_reports(done: DataFrame, reporter_name: Column) -> DataFrame:
    """O-F1: report rows with id, filing order and all moderation flags
    false; the message columns come with ``attach_messages``."""
    return (done.withColumn("report_id", uuid_like("author_id", "start_seq"))
            .withColumn("reporter_id", F.col("author_id"))
            .withColumn("reporter", reporter_name)
            .withColumn("is_auto", F.lit(False))
            .withColumn("report_seq", F.col("end_seq"))
            .withColumn("position", F.lit(0))
            .withColumn("parent_id", F.lit(None).cast("string")))


def attach_messages(reports: DataFrame, msgs: DataFrame) -> DataFrame:
    """Author, time, text and link of each report's message (one look-up for
    parents and children alike)."""
    m = msgs.select("message_id", "author_name", F.col("created_at").alias("message_created_at"), "content", "jump_url")
    return reports.join(m, "message_id", "left")


def auto_report_rows(auto: DataFrame, msgs: DataFrame) -> DataFrame:
    """O-F9: automatic reports (from the cascade) in the report schema, so
    that they are posted, rendered and folded like the others.  They are
    filed when the message arrives, by no user, and block nobody."""
    none = F.lit(None).cast("string")
    m = msgs.select("message_id", "author_name", "created_at", "content", "jump_url")
    return (auto.join(m, "message_id")
            .withColumn("report_created_at", F.col("created_at"))
            .withColumnRenamed("created_at", "message_created_at")
            .withColumn("reporter_id", F.lit(None).cast("bigint"))
            .withColumn("report_seq", F.lit(None).cast("bigint")).withColumn("position", F.lit(0))
            .withColumn("parent_id", none).withColumn("harassment_type", none).withColumn("imminent_danger", none)
            .withColumn("multiple_harassers", F.lit(None).cast("boolean"))
            .withColumn("other_message_ids", F.array().cast("array<bigint>"))
            .withColumn("safety_mode", F.lit(False)).withColumn("block_requested", F.lit(False))
            .withColumn("block_user", F.array().cast("array<string>")))


def expand_related(reports: DataFrame) -> DataFrame:
    """O-F5: every extra message becomes its own report, copying type,
    subtype and safety; it blocks its own author iff the parent blocked."""
    own = F.array(F.struct(F.lit(0).alias("at"), F.col("message_id").alias("mid")))
    extra = F.transform("other_message_ids", lambda m, k: F.struct((k + 1).alias("at"), m.alias("mid")))
    rows = reports.withColumn("_x", F.explode(F.concat(own, F.coalesce(extra, F.array().cast("array<struct<at:int,mid:bigint>>")))))
    child = F.col("_x.at") > 0
    return (rows.withColumn("message_id", F.col("_x.mid")).withColumn("position", F.col("_x.at"))
            .withColumn("parent_id", F.when(child, F.col("report_id")))
            .withColumn("report_id", F.when(child, uuid_like("report_id", F.col("_x.at") - 1)).otherwise(F.col("report_id")))
            .withColumn("other_message_ids", F.when(child, F.array().cast("array<bigint>")).otherwise(F.col("other_message_ids")))
            .select(*reports.columns))


def block_sets(expanded: DataFrame) -> DataFrame:
    """O-F6: blocked user names per report (rows with ``author_name``).

    Parent: distinct authors of its message and of its extra messages, which
    are its children's; child: its own author.  Both only when blocking was
    requested.  A dialog files a handful of reports, so its window is small.
    """
    family = Window.partitionBy(F.coalesce("parent_id", "report_id"))
    names = F.when(F.col("parent_id").isNull(), F.array_sort(F.collect_set("author_name").over(family))).otherwise(
        F.array_compact(F.array("author_name")))
    return expanded.withColumn("block_user", F.when(F.col("block_requested"), names).otherwise(F.array().cast("array<string>")))


def account_size(reports: DataFrame, accounts: DataFrame, name_col: str = "author_name") -> DataFrame:
    """O-F7: followers > 5000 (strict) -> large account -> strike ‼️ else ❗.

    Unknown accounts get the default (small)."""
    a = accounts.select(F.col("user_name").alias("_u"), "followers")
    j = reports.join(a, reports[name_col] == F.col("_u"), "left").drop("_u")
    f = F.coalesce(F.col("followers"), F.lit(DEFAULT_FOLLOWERS))
    return (j.withColumn("followers", f)
             .withColumn("large_account", f > LARGE_ACCOUNT_FOLLOWERS)
             .withColumn("strike_emoji", F.when(f > LARGE_ACCOUNT_FOLLOWERS, F.lit(STRIKE_LARGE))
                         .otherwise(F.lit(STRIKE_SMALL))))


def _pybool(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


def _header(t: Column) -> Column:
    """Report header and type-specific lines shared by all report texts."""
    sub = (F.when(t == "Other", F.concat(F.lit("\t\tAbuse Type Details: "),
                                          F.coalesce(F.col("other_details"), F.lit("None")), F.lit("\n")))
           .when(t == "Harassment", F.concat(
               F.lit("\t\tHarassment Type: "), F.coalesce(F.col("harassment_type"), F.lit("None")),
               F.lit("\n\t\tMultiple Harassers: "),
               F.coalesce(_pybool(F.col("multiple_harassers")), F.lit("None")), F.lit("\n")))
           .when(t == "Imminent Danger", F.concat(F.lit("\t\tImminent Danger Type: "),
                                                  F.coalesce(F.col("imminent_danger"), F.lit("None")),
                                                  F.lit("\n")))
           .otherwise(F.lit("")))
    return F.concat(
        F.lit("Report "), F.col("report_id"), F.lit(" at time "),
        F.date_format("report_created_at", "yyyy-MM-dd HH:mm:ss"), F.lit(":\n\tReported message:\n\t"),
        F.coalesce(F.col("author_name"), F.lit("")), F.lit(': "'), F.coalesce(F.col("content"), F.lit("")),
        F.lit('"\n\tLink:'), F.coalesce(F.col("jump_url"), F.lit("")),
        F.lit("\n\tReporter: "), F.col("reporter"), F.lit("\n\tAbuse Type: "), t, F.lit("\n"), sub)


def _sender_blocked() -> Column:
    return F.coalesce(F.array_contains("block_user", F.col("author_name")), F.lit(False))


def format_report(df: DataFrame) -> DataFrame:
    """O-F8: the mod-channel report text (user and automatic variants)."""
    auto = F.col("is_auto")
    text = F.concat(
        _header(F.col("abuse_type")),
        F.lit("\tHas reporter turned on safety mode: "), _pybool(F.col("safety_mode")),
        F.lit("\n\tHas reporter blocked message sender: "), _pybool(_sender_blocked()),
        F.lit("\nPress ⏱️ to place abuser under slow mode.\n"),
        F.when(~auto, F.lit("Press 🛑 to block abuser for reporter.\n")).otherwise(F.lit("")),
        F.lit("Press 🗑️ to delete the message.\nPress "), F.col("strike_emoji"),
        F.lit(" to send strike and warning to abuser.\nPress ❌ to ban abuser.\n"),
        F.when(~auto, F.lit("Press ❔ to strike reporter for false report. (Only strike if false report "
                            "is intentional and malicious)\n")).otherwise(F.lit("")),
        F.lit("Press ⬆️ to escalate to a specialized team that handles organized harassment"))
    return df.select("report_id", text.alias("report_text"))


STATUS_FLAGS = ["false_report_strike", "slow_mode", "blocked", "deleted", "strike", "escalation", "banned"]


def report_details(df: DataFrame) -> Column:
    """The details text of the search command (flags from the status fold)."""
    def given(c):
        return F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)

    def flag(c):
        return _pybool(given(c))
    return F.concat(
        _header(F.col("abuse_type")),
        F.lit("\tHas reporter turned on safety mode: "), _pybool(F.col("safety_mode")),
        F.lit("\n\tIs this a false report: "), flag("false_report_strike"),
        F.lit("\n\tHas the sender been placed on slow mode: "), flag("slow_mode"),
        F.lit("\n\tHas the sender been blocked: "), _pybool(_sender_blocked() | given("blocked")),
        F.lit("\n\tHas the message been deleted: "), flag("deleted"),
        F.lit("\n\tHas the message sender been given a strike: "), flag("strike"),
        F.lit("\n\tHas the message been escalated: "), flag("escalation"), F.lit("\n"))


# Closing texts by abuse type.
ACK_HEAD = "Thank you for reporting {type}. Your report has been filed as report {id}.\n" \
           "We will notify you when your report has been reviewed and appropriate actions has been taken.\n"
ACK_HARASSMENT = "This may include a warning or banning the user and removing the content."
ACK_DANGER = "This may include notification of authorities if necessary."
ACK_OTHER = "This may include removing the content."


def acknowledge(df: DataFrame) -> DataFrame:
    """O-F12: the closing message sent to the reporter."""
    from ..functions.render import template
    head = template(ACK_HEAD, type=F.col("abuse_type"), id=F.col("report_id"))
    tail = (F.when(F.col("abuse_type") == "Harassment", F.lit(ACK_HARASSMENT))
            .when(F.col("abuse_type") == "Imminent Danger", F.lit(ACK_DANGER))
            .otherwise(F.lit(ACK_OTHER)))
    return df.select("report_id", F.concat(head, tail).alias("ack_text"))


def report_posts(reports: DataFrame) -> DataFrame:
    """O-F13: posted report message id <-> report id (bridge table).

    The post id is derived from the report id (60 bits of its SHA-256), so a
    replay posts under the same id."""
    post = F.conv(F.substring(F.sha2(F.col("report_id"), 256), 1, 15), 16, 10).cast("bigint")
    return reports.select(post.alias("post_id"), "report_id")


def list_my_reports(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """O-F10: the reports filed by each requesting user, one row per report
    with its filing order (``report_seq``, and ``position`` among the reports
    of one dialog); users without reports are kept with a null id.  Rows, not one array per user: a user may have filed
    any number of reports."""
    r = reports.select(F.col("reporter_id").alias("author_id"), "report_id", "report_seq", "position")
    return requests.join(r, "author_id", "left")


# Replies of the report search command.
SEARCH_USAGE = "Please search for report with command `search \\{report_id\\}`"
SEARCH_INVALID = "Invalid ID. Please search for a report id that you have filed."


def search_reports(requests: DataFrame, reports: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """O-F11: ``search <id>``: usage text unless exactly two space-separated
    tokens; silence for a malformed id; "Invalid ID" unless the id exists and
    was filed by the requester; else the report details (moderation flags
    from ``status``, the O-G3 fold, false when absent)."""
    toks = F.split(strip_content(F.col("content")), " ", -1)
    q = (requests.withColumn("_n", F.size(toks)).withColumn("_id", F.get(toks, 1))
         .withColumn("_uuid", F.lower(F.regexp_replace("_id", "-", ""))))
    r = reports
    if status is not None:
        r = r.join(status.select("report_id", *[c for c in STATUS_FLAGS if c in status.columns]),
                   "report_id", "left")
    r = r.select(F.lower(F.regexp_replace("report_id", "-", "")).alias("_uuid"),
                 F.col("reporter_id").alias("_owner"), F.col("report_id").alias("found_id"),
                 report_details(r).alias("_details"))
    j = q.join(r, "_uuid", "left")
    reply = (F.when(F.col("_n") != 2, F.lit(SEARCH_USAGE))
             .when(~F.coalesce(F.col("_id").rlike(UUID_PATTERN), F.lit(False)), F.lit(None))
             .when(F.col("found_id").isNull() | (F.col("_owner") != F.col("author_id")), F.lit(SEARCH_INVALID))
             .otherwise(F.col("_details")))
    return j.withColumn("reply", reply).drop("_n", "_id", "_uuid", "_owner", "_details")


def strip_content(c: Column) -> Column:
    from ..functions.text import strip_ws
    return strip_ws(c)
