"""Message routing (O-B1..B6): gates, mod-channel routes and DM commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Direct-message command keywords.
HELP_KEYWORD = "help"
REPORT_KEYWORD = "report"
CANCEL_KEYWORD = "cancel"
LIST_KEYWORD = "blocklist"
BOT_NAME_PATTERN = r"[gG]roup ([0-9]+) [bB]ot"


def drop_own(df: DataFrame, bot_id: int) -> DataFrame:
    """O-B1: ignore messages the bot itself sent."""
    return df.where(F.col("author_id") != F.lit(bot_id))


def split_dm(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-B2: (channel messages, direct messages)."""
    return df.where(F.col("guild_id").isNotNull()), df.where(F.col("guild_id").isNull())


def monitored(df: DataFrame, group: int) -> DataFrame:
    """O-B3: only the group's own channel (equality, pushed to the scan)."""
    return df.where(F.col("channel_name") == F.lit(f"group-{group}"))


def group_number(bot_name: str) -> int:
    """Group number parsed from the bot's name; a name without it is an error."""
    import re
    m = re.search(BOT_NAME_PATTERN, bot_name)
    if not m:
        raise ValueError('Group number not found in bot name; expected "Group # Bot"')
    return int(m.group(1))


def build_routes(channels: DataFrame, bot_name: str) -> DataFrame:
    """O-B4: per guild, the human-mod and auto-mod channel ids.

    ``channels(guild_id, channel_id, channel_name, position)``; when several
    channels carry the name, the last one in position order wins.
    One partial aggregate per guild, so a guild with many channels is
    combined map-side before the shuffle.
    """
    n = group_number(bot_name)
    human = F.col("channel_name") == F.lit(f"group-{n}-human-mod")
    auto = F.col("channel_name") == F.lit(f"group-{n}-mod")
    return (channels.where(human | auto)
            .groupBy("guild_id")
            .agg(F.max_by(F.when(human, F.col("channel_id")),
                          F.when(human, F.col("position"))).alias("human_mod_channel"),
                 F.max_by(F.when(auto, F.col("channel_id")),
                          F.when(auto, F.col("position"))).alias("auto_mod_channel")))


def route(df: DataFrame, routes: DataFrame) -> DataFrame:
    """O-B5: attach the guild's mod channels (left join: unknown guild -> null).

    Routes hold one row per guild; adaptive execution broadcasts them from
    their measured size (a pre-count would recompute the aggregate).
    """
    return df.join(routes, "guild_id", "left")


def classify_command(df: DataFrame, in_report: str = "in_report_session",
                     in_list: str = "in_list_session") -> DataFrame:
    """O-B6: direct-message text -> command; first rule that applies wins."""
    c = F.col("content")
    cmd = (F.when(c == HELP_KEYWORD, F.lit("help"))
           .when(F.coalesce(F.col(in_report), F.lit(False)), F.lit("report_session"))
           .when(F.coalesce(F.col(in_list), F.lit(False)), F.lit("list_session"))
           .when(c.startswith(REPORT_KEYWORD), F.lit("report"))
           .when(c.startswith(LIST_KEYWORD), F.lit("blocklist"))
           .when(c.startswith("list"), F.lit("list"))
           .when(c.startswith("strike"), F.lit("strike"))
           .when(c.startswith("search"), F.lit("search"))
           .otherwise(F.lit("ignore")))
    return df.withColumn("command", cmd)
