"""The evaluation cascade and its consumers (O-D4, O-D6..D9, O-F9).

Order per message: blocked term -> blocked pattern -> street address ->
scorer ensemble; the first stage that decides wins, default ``(0, 'N/A')``.

With JVM scorers (columns computed by Spark expressions) the cascade is one
projection: a CASE chain whose later branches run only for undecided rows,
bound through lambdas so each normalised text is computed once.  With a
Python scorer (``python_scorer=True``) the undecided rows are filtered out
first and only they reach the scorer, so no paid call is made for a message
a list already decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render as R
from ..functions.replies import PRODUCTION_THRESHOLDS, threshold_first, verdict_prefix
from ..functions.text import bind, with_normalized
from .matching import first_pattern_hit, match_terms, validate_patterns

DECISION_TYPE = ("struct<score:double,reason:string,stage:string,"
                 "attribute:string,chat_flag:boolean>")
# Reporter of automatic reports and their detail texts.
AUTO_REPORTER = "auto report"
AUTO_TYPE = "Other"
DETAIL_CHAT = "Flagged by open ai"
DETAIL_ATTR_PREFIX = "Flagged by perspective for high "
DETAIL_ATTR_SUFFIX = " value"


def pii_flag(text: Column, rules: list[str]) -> Column:
    """O-D4: any street-address rule matches the folded text."""
    if not rules:
        return F.lit(False)
    return text.rlike("|".join(f"(?:{r})" for r in rules))


def _decision(score, reason, stage, attribute=None, chat=None) -> Column:
    return F.struct(F.lit(score).cast("double").alias("score") if not isinstance(score, Column)
                    else score.cast("double").alias("score"),
                    reason.alias("reason") if isinstance(reason, Column) else F.lit(reason).alias("reason"),
                    F.lit(stage).alias("stage"),
                    (attribute if attribute is not None else F.lit(None).cast("string")).alias("attribute"),
                    (chat if chat is not None else F.lit(None).cast("boolean")).alias("chat_flag"))


def ensemble(attribute: Column, chat_flag: Column) -> Column:
    """O-D7: both scorers -> 1; exactly one -> 0.5 (+ auto report); none -> 0."""
    a = attribute.isNotNull()
    return (F.when(a & chat_flag, _decision(1.0, R.REASON_BOTH, "ensemble", attribute, chat_flag))
            .when(chat_flag, _decision(0.5, R.REASON_CHAT_ONLY, "ensemble", attribute, chat_flag))
            .when(a, _decision(0.5, R.REASON_ATTR_ONLY, "ensemble", attribute, chat_flag))
            .otherwise(_decision(0.0, R.REASON_NONE, "none", attribute, chat_flag)))


def _list_stage(r: Column, patterns, pii_rules, rest) -> Column:
    """Term (``r.term_hit``) -> pattern -> address; ``rest(r)`` decides
    undecided rows."""
    def after_regex(rh):
        return (F.when(rh.isNotNull(),
                       _decision(1.0, R.hit_reason(R.REASON_REGEX, rh, r["stripped"]), "regex"))
                .when(pii_flag(r["folded"], pii_rules), _decision(1.0, R.REASON_PII, "pii"))
                .otherwise(rest(r)))
    return (F.when(r["term_hit"].isNotNull(),
                   _decision(1.0, R.hit_reason(R.REASON_TERM, r["term_hit"], r["stripped"]), "term"))
            .otherwise(bind(first_pattern_hit(r["folded"], patterns), after_regex)))


def evaluate(msgs: DataFrame, terms, patterns: list[str], pii_rules: list[str],
             scorer=None, thresholds=PRODUCTION_THRESHOLDS,
             python_scorer: bool = False, text_col: str = "content") -> DataFrame:
    """O-D6: add ``score, reason, stage, attribute, chat_flag`` per message.

    ``terms`` is a Python list or a term DataFrame, cleaned alike (a blank
    term never matches).  Patterns are validated here, before any row is read.

    ``scorer(df) -> df`` adds ``attr_scores map<string,double>`` and
    ``chat_content string`` (null = failed call, treated as not flagged).
    """
    validate_patterns(msgs.sparkSession, patterns)
    norm = match_terms(with_normalized(msgs, text_col), terms).drop("lowered")
    cols = ["stripped", "folded", "term_hit"]
    out = list(msgs.columns)

    def scored_rest(r):
        return ensemble(threshold_first(r["attr_scores"], thresholds),
                        verdict_prefix(r["chat_content"]))

    if scorer is None:
        norm = (norm.withColumn("attr_scores", F.lit(None).cast("map<string,double>"))
                    .withColumn("chat_content", F.lit(None).cast("string")))
        python_scorer = False
    elif not python_scorer:
        norm = scorer(norm)

    if not python_scorer:
        expr = bind(F.struct(*cols, "attr_scores", "chat_content"),
                    lambda r: _list_stage(r, patterns, pii_rules, scored_rest))
        return norm.select(*out, F.inline(F.array(expr)))

    # Python scorer: list stages first, scorer only on undecided rows.
    staged = norm.select(*out, *cols, bind(F.struct(*cols), lambda r: _list_stage(
        r, patterns, pii_rules, lambda _: F.lit(None).cast(DECISION_TYPE))).alias("_d"))
    from ..session import checkpoint_dir
    checkpoint_dir(msgs.sparkSession)  # the cluster's shared folder when set
    staged = staged.checkpoint()  # one list pass feeds both branches
    decided = staged.where(F.col("_d").isNotNull()).select(*out, "_d.*")
    rest = scorer(staged.where(F.col("_d").isNull()).drop("_d"))
    rest = rest.select(*out, F.inline(F.array(
        bind(F.struct("attr_scores", "chat_content"), scored_rest))))
    return decided.unionByName(rest)


def deletions(decisions: DataFrame) -> DataFrame:
    """O-D8: score 1 -> message deleted and a notice to its author."""
    notice = F.concat(F.lit("Your message "), F.col("jump_url"), F.lit(" with text "),
                      F.col("content"), F.lit(" has been deleted for reason: "),
                      F.col("reason"), F.lit("."))
    return decisions.where(F.col("score") == 1.0).select(
        "message_id", F.col("author_id").alias("recipient_id"), notice.alias("text"))


def auto_reports(decisions: DataFrame) -> DataFrame:
    """O-F9: exactly one scorer flagged (score 0.5) -> automatic report."""
    detail = F.when(F.col("chat_flag"), F.lit(DETAIL_CHAT)).otherwise(
        F.concat(F.lit(DETAIL_ATTR_PREFIX), F.col("attribute"), F.lit(DETAIL_ATTR_SUFFIX)))
    return decisions.where(F.col("score") == 0.5).select(
        F.sha2(F.concat_ws("|", F.lit("auto"), F.col("message_id").cast("string")), 256)
         .substr(1, 32).alias("report_id"),
        F.lit(AUTO_REPORTER).alias("reporter"),
        F.lit(True).alias("is_auto"),
        "message_id",
        F.lit(AUTO_TYPE).alias("abuse_type"),
        detail.alias("other_details"))


def format_evaluation(decisions: DataFrame, text_col: str = "content") -> DataFrame:
    """O-D9: the mod-channel line for every evaluated message."""
    return decisions.select("message_id", R.format_evaluation(
        F.col(text_col), F.col("score"), F.col("reason")).alias("evaluation"))
