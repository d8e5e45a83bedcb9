"""Blocked-term and blocked-pattern lists as an edit log (O-E1..E6).

The live lists of the reference are mutable sets; here they are the fold of
an edit log ``(edit_seq, edited_at, list_kind 'word'|'regex', op
'add'|'remove', content)``.  Each content holds one item per line.

Statuses need the previous operation on the same item.  A few items can
own most of the log, so that lag is computed in two levels: within blocks
of ``BLOCK`` sequence numbers (bounded partitions), then across blocks on a
per-block summary (one row per item and block), and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..session import stored
from .matching import term_hits

# Line separators of str.splitlines(), as a JVM / RE2 pattern.
LINE_BREAK = r"\r\n|[\n\x0B\x0C\r\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
BLOCK = 1_000_000

# Texts of the list views.
WORDS_HEADER = "The list of blocked words are:\n"
WORDS_EMPTY = "There are currently nothing in the blocklist."
REGEX_HEADER = "The list of blocked regex expressions are:\n"
REGEX_EMPTY = "There are currently no regex expressions blocked."


def split_lines(col: Column) -> Column:
    """``str.splitlines()``: the one trailing empty piece is not a line."""
    parts = F.split(col, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "",
                  F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def edit_lines(edits: DataFrame, check_patterns: bool = False) -> DataFrame:
    """O-E1: one row per edited item: words stripped and lowered, patterns
    kept verbatim.  Blank words are marked invalid (they would match every
    message).  With ``check_patterns`` a pattern the JVM cannot compile is
    invalid too: each distinct pattern is compiled once."""
    x = edits.select("*", F.posexplode(split_lines(F.col("content"))).alias("line_no", "raw"))
    item = F.when(F.col("list_kind") == "word", F.lower(strip_ws(F.col("raw")))).otherwise(F.col("raw"))
    valid = F.when(F.col("list_kind") == "word", F.length(item) > 0).otherwise(F.lit(True))
    x = x.withColumn("item", item).withColumn("valid", valid)
    if check_patterns:
        from .matching import invalid_patterns
        spark = edits.sparkSession
        items = x.where(F.col("list_kind") == "regex").select("item").distinct()
        bad = invalid_patterns(spark, [r[0] for r in items.toLocalIterator()])
        if bad:
            wrong = spark.createDataFrame([("regex", p, False) for p in bad], "list_kind string, item string, _ok boolean")
            x = (x.join(F.broadcast(wrong), ["list_kind", "item"], "left")
                  .withColumn("valid", F.col("valid") & F.coalesce("_ok", F.lit(True)))
                  .drop("_ok").select(*x.columns))
    return x


def with_seed(lines: DataFrame, seed_words: list[str] | None = None) -> DataFrame:
    """Initial list entries become adds before the first edit."""
    if not seed_words:
        return lines
    spark = lines.sparkSession
    seed = spark.createDataFrame([(w.strip().lower(),) for w in seed_words if w.strip()], "item string")
    seed = seed.distinct().select(
        F.lit(-1).cast("bigint").alias("edit_seq"),
        F.lit(None).cast("timestamp_ntz").alias("edited_at"),
        F.lit("word").alias("list_kind"), F.lit("add").alias("op"),
        F.col("item").alias("content"), F.lit(0).alias("line_no"),
        F.col("item").alias("raw"), "item", F.lit(True).alias("valid"))
    return lines.unionByName(seed.select(*lines.columns))


def neighbour(df: DataFrame, keys: list[str], value: str, out: str, direction: str = "lag") -> DataFrame:
    """``lag`` / ``lead`` of ``value`` per ``keys`` in (edit_seq, line_no) order,
    computed in two levels so no partition holds more than one block of
    ``BLOCK`` sequence numbers of one item: within blocks, then across a
    one-row-per-block summary (previous block's last / next block's first)."""
    v = df.withColumn("_blk", F.floor(F.col("edit_seq") / BLOCK))
    order = [F.col("edit_seq"), F.col("line_no")]
    w_in = Window.partitionBy(*keys, "_blk").orderBy(*order)
    step = F.lag if direction == "lag" else F.lead
    # values travel in a struct: a row whose value is null is still a row
    v = v.withColumn("_in", step(F.struct(value)).over(w_in))
    edge = F.max_by if direction == "lag" else F.min_by
    ends = v.groupBy(*keys, "_blk").agg(edge(F.struct(value), F.struct(*order)).alias("_edge"))
    w_blk = Window.partitionBy(*keys).orderBy("_blk")
    carry = ends.select(*keys, "_blk", step("_edge").over(w_blk).alias("_carry"))
    v = v.join(carry, keys + ["_blk"], "left")
    return v.withColumn(out, F.coalesce("_in", "_carry")[value]).drop("_blk", "_in", "_carry")


def previous_op(lines: DataFrame) -> DataFrame:
    """Add ``prev_op``: the op of the preceding line on the same item.

    Invalid (blank) words all carry the item '' and so only ever see each
    other; their status does not depend on it.
    """
    return neighbour(lines, ["list_kind", "item"], "op", "prev_op", "lag")


def apply_edits(edits: DataFrame, seed_words: list[str] | None = None,
                check_patterns: bool = False) -> DataFrame:
    """O-E2 / O-E3: per edited line, ``added | already | removed | missing``
    (``invalid`` for blank words and, with ``check_patterns``, for patterns
    the JVM cannot compile)."""
    st = previous_op(with_seed(edit_lines(edits, check_patterns), seed_words))
    status = (F.when(~F.col("valid"), F.lit("invalid"))
              .when((F.col("op") == "add") & (F.col("prev_op") == "add"), F.lit("already"))
              .when(F.col("op") == "add", F.lit("added"))
              .when(F.col("prev_op") == "add", F.lit("removed"))
              .otherwise(F.lit("missing")))
    return st.withColumn("status", status)


def current_list(edits: DataFrame, seed_words: list[str] | None = None,
                 check_patterns: bool = False) -> DataFrame:
    """O-E4: items present after all edits (last valid op is an add)."""
    lines = with_seed(edit_lines(edits, check_patterns), seed_words).where("valid")
    last = lines.groupBy("list_kind", "item").agg(
        F.max_by("op", F.struct("edit_seq", "line_no")).alias("last_op"))
    return last.where(F.col("last_op") == "add").select("list_kind", "item")


def render_list(current: DataFrame) -> DataFrame:
    """O-E5: the list views (sorted, since set order is unspecified).

    A view is one text per list and as long as its list.
    """
    kinds = current.sparkSession.createDataFrame([("word",), ("regex",)], "list_kind string")
    agg = current.groupBy("list_kind").agg(F.array_sort(F.collect_list("item")).alias("items"))
    j = kinds.join(agg, "list_kind", "left")
    body = F.array_join(F.col("items"), ",\n")
    has = F.coalesce(F.size("items"), F.lit(0)) > 0
    text = F.when(F.col("list_kind") == "word", F.concat(
        F.lit(WORDS_HEADER), F.when(has, body).otherwise(F.lit(WORDS_EMPTY))
    )).otherwise(F.concat(F.lit(REGEX_HEADER), F.when(has, body).otherwise(F.lit(REGEX_EMPTY))))
    return j.select("list_kind", text.alias("view"))


def versions(edits: DataFrame, seed_words: list[str] | None = None) -> DataFrame:
    """Validity intervals ``[valid_from, valid_to)`` of every list item.

    An item becomes live at an ``added`` line and leaves at the next
    ``removed`` line for it (null end = still live, or removed at no known
    time).
    """
    st = apply_edits(edits, seed_words).where(F.col("status").isin("added", "removed"))
    nxt = neighbour(st, ["list_kind", "item"], "edited_at", "_end", "lead")
    return (nxt.where(F.col("status") == "added")
               .select("list_kind", "item", F.col("edited_at").alias("valid_from"),
                       F.col("_end").alias("valid_to")))


def candidate_words(edits: DataFrame, seed_words: list[str] | None = None) -> DataFrame:
    """Every word that was ever listed: the match vocabulary of ``list_as_of``.

    Needs only the split edit lines (no statuses), so fetching it is cheap.
    """
    lines = edit_lines(edits).where(F.col("valid") & (F.col("list_kind") == "word"))
    words = lines.select(F.col("item").alias("term"))
    if seed_words:
        seed = edits.sparkSession.createDataFrame(
            [(w.strip().lower(),) for w in seed_words if w.strip()], "term string")
        words = words.unionByName(seed)
    return words.distinct()


def list_changes(edits: DataFrame, seed_words: list[str] | None = None) -> DataFrame:
    """``term, at, seq, live``: each word line that adds or removes, as it is
    (repeated adds change nothing); a line without a time counts from the
    beginning."""
    lines = with_seed(edit_lines(edits), seed_words).where(F.col("valid") & (F.col("list_kind") == "word"))
    return lines.select(F.col("item").alias("term"), F.col("edited_at").alias("at"),
                        F.struct("edit_seq", "line_no").alias("seq"), (F.col("op") == "add").alias("live"))


def list_as_of(msgs: DataFrame, changes: DataFrame, time_col: str = "created_at",
               text_col: str = "lowered", block: str = "DAY") -> DataFrame:
    """O-E6: (message, term) hits judged by the list as it stood on arrival.

    Messages are matched once against every term that was ever listed.  The
    changes of a term are packed, in order, by blocks of time (``block``),
    together with the state at the start of the block; a hit looks its time
    up in the pack of its block.  Hits are never ordered, so neither a term
    that hits often nor a crowded day is one task; a pack holds the changes
    of one term in one block.
    """
    hits = term_hits(msgs, changes.select("term").distinct(), text_col, keep=[time_col])
    hits = hits.select("term", F.col(time_col).cast("timestamp_ntz").alias("_at"), "message_id").withColumn("_blk", F.date_trunc(block, "_at"))
    # read twice below, and the texts are to be matched once
    hits = stored(hits, "list-hits")
    first = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    edits = changes.select("term", F.coalesce(F.col("at").cast("timestamp_ntz"), first).alias("at"), "seq", "live")
    packs = (edits.groupBy("term", F.date_trunc(block, "at").alias("_blk"))
             .agg(F.array_sort(F.collect_list(F.struct("at", "seq", "live"))).alias("_pack")))
    # the days on which a term hits or changes, with the state each one begins with
    days = hits.select("term", "_blk").distinct().join(packs, ["term", "_blk"], "full")
    earlier = Window.partitionBy("term").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_carry", F.last(F.element_at("_pack", -1)["live"], ignorenulls=True).over(earlier))
    state = hits.join(days, ["term", "_blk"]).withColumn(
        "_done", F.filter("_pack", lambda c: c["at"] <= F.col("_at")))
    on = F.when(F.size("_done") > 0, F.element_at("_done", -1)["live"])
    state = state.withColumn("_on", F.coalesce(on, "_carry", F.lit(False)))
    return state.where("_on").select("message_id", "term").distinct()
