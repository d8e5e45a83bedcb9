"""Moderator actions: validation, correlation, status fold, notices
(O-G1..G3, O-G8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import render as R
from . import strikes as ST

# Moderator reactions and what each one means.
SLOW, BLOCK, DELETE, STRIKE, STRIKE_LARGE, BAN, FALSE_REPORT, ESCALATE = (
    "⏱️", "🛑", "🗑️", "❗", "‼️", "❌", "❔", "⬆️")
ACTION_SET = [SLOW, BLOCK, DELETE, STRIKE, STRIKE_LARGE, BAN, FALSE_REPORT, ESCALATE]
ABUSE_HORIZON_DAYS = 365
FALSE_REPORT_HORIZON_DAYS = 30


def valid_actions(actions: DataFrame, routes: DataFrame, posts: DataFrame, bot_id: int) -> DataFrame:
    """O-G1: reaction in the guild's human-mod channel, on a posted report,
    with a known emoji, not by the bot.  Routes (one row per guild) are
    broadcast by adaptive execution from their measured size (they are an
    aggregate, so a count beforehand would recompute them); posts are a
    semi-join."""
    r = routes.select("guild_id", "human_mod_channel")
    return (actions.where(F.col("emoji").isin(ACTION_SET) & (F.col("actor_id") != F.lit(bot_id)))
            .join(r, "guild_id")
            .where(F.col("channel_id") == F.col("human_mod_channel")).drop("human_mod_channel")
            .join(posts.select("post_id"), "post_id", "left_semi"))


def correlate(valid: DataFrame, posts: DataFrame, reports: DataFrame) -> DataFrame:
    """O-G2: action -> report -> abuser and reporter (equi-joins)."""
    return (valid.join(posts.select("post_id", "report_id"), "post_id")
                 .join(reports.drop("post_id"), "report_id"))


def with_strikes(corr: DataFrame, mode: str = "replay") -> DataFrame:
    """Attach ``n_abuse`` / ``n_false`` to strike actions (O-G4, O-G5).

    Both kinds are counted in one pass over (kind, user, time, sequence) and
    attached by the action; the default is exact for actions handled out of
    report order.
    """
    e = F.col("emoji")
    res = ST.multi_horizon_strikes(corr, {
        "abuse": (e.isin(STRIKE, STRIKE_LARGE), F.col("abuser_id"), ABUSE_HORIZON_DAYS),
        "false": ((e == FALSE_REPORT) & ~F.col("is_auto"), F.col("reporter_id"), FALSE_REPORT_HORIZON_DAYS),
    }, "action_seq", "report_created_at", "_n", mode)
    return (res.withColumn("n_abuse", F.when(F.col("strike_kind") == "abuse", F.col("_n")))
               .withColumn("n_false", F.when(F.col("strike_kind") == "false", F.col("_n")))
               .drop("_n", "strike_kind"))


def report_status(struck: DataFrame) -> DataFrame:
    """O-G3: fold a report's actions into its flags (partial aggregation)."""
    e = F.col("emoji")
    banned_by_strike = F.col("n_abuse") >= 3
    return struck.groupBy("report_id").agg(
        F.bool_or(e == SLOW).alias("slow_mode"),
        F.bool_or(e == BLOCK).alias("blocked"),
        F.bool_or(e == DELETE).alias("deleted"),
        F.bool_or((e == BAN) | F.coalesce(banned_by_strike, F.lit(False))).alias("banned"),
        F.bool_or(e == ESCALATE).alias("escalation"),
        F.bool_or(e.isin(STRIKE, STRIKE_LARGE)).alias("strike"),
        F.bool_or((e == FALSE_REPORT) & F.coalesce(F.col("n_false") < 3, F.lit(False)))
         .alias("false_report_strike"))


def notifications(struck: DataFrame) -> DataFrame:
    """O-G8: one row per (action, recipient) with the notice text.

    Needs ``jump_url, content, abuse_type`` next to the correlated action.
    No abuser notice for block / escalate / false-report; no reporter notice
    on automatic reports; a false-report reaction on an automatic report is
    ignored.
    """
    e, n_a, n_f = F.col("emoji"), F.col("n_abuse"), F.col("n_false")
    ctx = dict(url=F.col("jump_url"), content=F.col("content"), type=F.col("abuse_type"),
               id=F.col("report_id"), n=F.coalesce(n_a, n_f))
    t = lambda s: R.template(s, **{k: v for k, v in ctx.items() if "{" + k + "}" in s})
    large = e == STRIKE_LARGE
    abuser = (F.when(e == SLOW, t(R.NOTICE_SLOW_ABUSER))
              .when(e == DELETE, t(R.NOTICE_DELETED_ABUSER))
              .when(e == BAN, t(R.NOTICE_BANNED_ABUSER))
              .when(e.isin(STRIKE, STRIKE_LARGE) & (n_a == 2) & large, t(R.NOTICE_STRIKE_SLOWED))
              .when(e.isin(STRIKE, STRIKE_LARGE) & (n_a < 3) & ~large, t(R.NOTICE_STRIKE_WARNED))
              .when(e.isin(STRIKE, STRIKE_LARGE) & (n_a < 3), t(R.NOTICE_STRIKE_WARNED_LARGE))
              .when(e.isin(STRIKE, STRIKE_LARGE), t(R.NOTICE_STRIKE_BANNED)))
    reporter = (F.when(F.col("is_auto"), F.lit(None))
                .when(e == SLOW, t(R.NOTICE_REPORTER_SLOW))
                .when(e == BLOCK, t(R.NOTICE_REPORTER_BLOCK))
                .when(e == DELETE, t(R.NOTICE_REPORTER_DELETED))
                .when(e == BAN, t(R.NOTICE_REPORTER_BANNED))
                .when(e == ESCALATE, t(R.NOTICE_REPORTER_ESCALATED))
                .when(e == FALSE_REPORT, F.when(n_f < 3, t(R.NOTICE_FALSE_STRUCK))
                      .otherwise(t(R.NOTICE_FALSE_RESTRICTED)))
                .when(e.isin(STRIKE, STRIKE_LARGE) & (n_a == 2) & large, t(R.NOTICE_REPORTER_SLOWED))
                .when(e.isin(STRIKE, STRIKE_LARGE) & (n_a < 3), t(R.NOTICE_REPORTER_STRUCK))
                .when(e.isin(STRIKE, STRIKE_LARGE), t(R.NOTICE_REPORTER_BANNED)))
    arr = F.array(
        F.struct(F.lit("abuser").alias("recipient_role"), F.col("abuser_id").alias("recipient_id"),
                 abuser.alias("text")),
        F.struct(F.lit("reporter").alias("recipient_role"), F.col("reporter_id").alias("recipient_id"),
                 reporter.alias("text")))
    return (struck.select("action_seq", F.inline(arr)).where(F.col("text").isNotNull()))
