"""Scorer replies: JSON parsing, thresholds and verdicts (O-A3, O-A4, O-D2,
O-D3, O-D5).  A null reply is a failed scorer call; every decision treats
it as "not flagged" (fail-open) and keeps it visible as a null column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Production attribute order and thresholds (first exceeding
# attribute in this order is reported).
PRODUCTION_THRESHOLDS = [("TOXICITY", 0.5), ("SPAM", 0.7), ("IDENTITY_ATTACK", 0.5),
                         ("INSULT", 0.5), ("THREAT", 0.8)]
# The alternative threshold sets used in classifier evaluation.
EVAL_THRESHOLDS_LOW = [("TOXICITY", 0.5), ("IDENTITY_ATTACK", 0.5), ("INSULT", 0.5)]
EVAL_THRESHOLDS_HIGH = [("TOXICITY", 0.8), ("IDENTITY_ATTACK", 0.8), ("INSULT", 0.8)]
# Verdict prefixes of the chat scorers (case-sensitive, untrimmed).
HARASSMENT_PREFIX = "Yes"
ADDRESS_PREFIX = "True"

ATTRIBUTE_REPLY_SCHEMA = "attributeScores map<string, struct<summaryScore: struct<value: double>>>"
CHAT_REPLY_SCHEMA = "choices array<struct<message: struct<content: string>>>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_attribute_reply(col) -> Column:
    """Reply JSON -> ``map<attribute, score>`` (null when the call failed)."""
    parsed = F.from_json(_c(col), ATTRIBUTE_REPLY_SCHEMA)
    return F.transform_values(parsed["attributeScores"],
                              lambda k, v: v["summaryScore"]["value"])


def parse_chat_reply(col) -> Column:
    """Reply JSON -> first choice's message content (null when failed)."""
    parsed = F.from_json(_c(col), CHAT_REPLY_SCHEMA)
    return F.get(parsed["choices"], 0)["message"]["content"]


def verdict_prefix(content, prefix: str = HARASSMENT_PREFIX) -> Column:
    """True iff the reply text starts with ``prefix``; failed call -> false."""
    return F.coalesce(_c(content).startswith(prefix), F.lit(False))


def threshold_first(scores, thresholds=PRODUCTION_THRESHOLDS) -> Column:
    """First attribute (declared order) whose score is strictly above its
    threshold; null when none.  A missing or null score never exceeds."""
    s = _c(scores)
    return F.coalesce(*[F.when(F.try_element_at(s, F.lit(a)) > F.lit(float(t)), F.lit(a))
                        for a, t in thresholds])


def any_over(scores, thresholds) -> Column:
    """Evaluation-script prediction: any attribute above its threshold."""
    return threshold_first(scores, thresholds).isNotNull()
