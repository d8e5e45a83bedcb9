"""Rendering of reasons, evaluations and notices as string Columns.

Texts are built with ``concat`` / ``concat_ws`` so they stay JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reason texts of the evaluation cascade.
REASON_TERM = "contains blocked word or expression: "
REASON_REGEX = "contains blocked regex "
REASON_PII = "contains pii: home street"
REASON_BOTH = "post has been flagged by openai and perspective for potential harassment\n"
REASON_CHAT_ONLY = "post has been flagged by openai and a report was sent\n"
REASON_ATTR_ONLY = "post has been flagged by perspective and a report was sent\n"
REASON_NONE = "N/A"


def highlight(original: Column, start: Column, end: Column) -> Column:
    """``original`` with ``[start, end)`` wrapped in backticks (0-based).

    Offsets may come from a differently folded text; slicing clamps like
    Python slices do.
    """
    return F.concat(
        F.substring(original, F.lit(1), start),
        F.lit("`"),
        F.substring(original, start + 1, F.greatest(end - start, F.lit(0))),
        F.lit("`"),
        F.substring(original, end + 1, F.lit(1 << 30)),
    )


def hit_reason(prefix: str, hit: Column, original: Column) -> Column:
    """``<prefix>`<item>` at "<highlighted original>"``."""
    return F.concat(F.lit(prefix + "`"), hit["item"], F.lit('` at "'),
                    highlight(original, hit["start"], hit["end"]), F.lit('"'))


def score_text(score: Column) -> Column:
    """Score as the reference prints it: 0, 0.5 or 1."""
    return (F.when(score == 0.5, F.lit("0.5"))
            .otherwise(score.cast("bigint").cast("string")))


def format_evaluation(text: Column, score: Column, reason: Column) -> Column:
    """O-D9: ``Evaluated: '<text>': <score>, reason: <reason>``."""
    return F.concat(F.lit("Evaluated: '"), text, F.lit("': "), score_text(score),
                    F.lit(", reason: "), reason)


def template(text: str, **cols: Column) -> Column:
    """Fill ``{name}`` placeholders of a fixed text with Columns (concat)."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", text):
        if m.start() > pos:
            parts.append(F.lit(text[pos:m.start()]))
        parts.append(cols[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(text):
        parts.append(F.lit(text[pos:]))
    return F.concat(*parts)


# Notices sent to the abuser and the reporter after a
# moderator action ({url}, {content}, {type}, {id}, {n} are filled in).
_HEAD = "Your message {url} with text {content} has been reported for {type}."
NOTICE_SLOW_ABUSER = _HEAD + " \nAs such, your account would be placed under slow mode for the next 72 hours."
NOTICE_DELETED_ABUSER = _HEAD + " \nAs such, your message has been deleted."
NOTICE_BANNED_ABUSER = (_HEAD + "\nYour account has been banned for abuse. If you wish to appeal your ban, "
                        "please go to our appeal website.")
NOTICE_STRIKE_SLOWED = (_HEAD + " \nYour account has been given a strike for abuse and is currently at {n} strikes."
                        "\nSince you have a large account, your account has been slowed down for 2 strikes. "
                        "\nYou would be banned if you reach 3 strikes."
                        "\nAs a large account, please demonstrate caution before sharing or posting and "
                        "refrain from posting any abuse")
NOTICE_STRIKE_WARNED = (_HEAD + " \nYour account has been given a strike for abuse and is currently at {n} strikes."
                        "\nYou would be banned if you reach 3 strikes.\nPlease refrain from posting abuse.")
NOTICE_STRIKE_WARNED_LARGE = (_HEAD + " \nYour account has been given a strike for abuse and is currently at {n} strikes."
                              "\nSince you have a large account, your account would be slowed down if you reach 2 strikes. "
                              "\nYou would be banned if you reach 3 strikes."
                              "\nAs a large account, please demonstrate caution before sharing or posting and "
                              "refrain from posting any abuse")
NOTICE_STRIKE_BANNED = (_HEAD + "\nYou have reached three strikes for abuses.\nYour account has been banned. "
                        "If you wish to appeal your ban, please go to our appeal website.")
NOTICE_REPORTER_SLOW = "Your report {id} has been resolved. The abuser has been placed under slow mode."
NOTICE_REPORTER_BLOCK = "Your report {id} has been resolved. All messages from the abuser will now be blocked."
NOTICE_REPORTER_DELETED = "Your report {id} has been resolved. The message has been deleted."
NOTICE_REPORTER_BANNED = "Your report {id} has been resolved. The abuser has been banned."
NOTICE_REPORTER_ESCALATED = "Your report {id} has been escalated to a specialized team."
NOTICE_REPORTER_SLOWED = "Your report {id} has been resolved. The abuser has been placed on slow mode."
NOTICE_REPORTER_STRUCK = "Your report {id} has been resolved. The abuser has been given a strike."
NOTICE_FALSE_STRUCK = ("Your report {id} has been resolved and classified as a malicious false report."
                       "\nYou have been given a strike and is currently at {n} strikes."
                       "\nYou would be restricted from filing reports if you reach 3 strikes. "
                       "Please refrain from filing malicious false reports.")
NOTICE_FALSE_RESTRICTED = ("Your report {id} has been resolved and classified as a malicious false report."
                           "\nYou have reached three strikes for false reports. "
                           "\nYour account has been restricted from filing further malicious reports. "
                           "If you wish to appeal the restriction, please go to our appeal website.")
