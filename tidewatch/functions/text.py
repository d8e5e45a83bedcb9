"""Text normalisation, link parsing and choice decoding as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import fold_tables, python_whitespace

# A message link is the first run of three slash-separated decimal ids.
LINK_PATTERN = r"/([0-9]+)/([0-9]+)/([0-9]+)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(col, fn) -> Column:
    """Evaluate ``fn(x)`` with ``x`` bound to the value of ``col`` once.

    The optimizer inlines projected expressions into later filters and
    projections; a long text expression referenced many times by ``fn``
    (once per term, say) would be recomputed for every reference.  Binding
    it as a lambda variable computes it once per row.
    """
    return F.transform(F.array(_c(col)), fn)[0]


def present(df, col: str, alias: str = "h"):
    """Rows where ``col`` is not null, via a generator instead of a filter.

    A filter on an expensive derived column is pushed below the projection
    that computes it and re-evaluates it; exploding a zero-or-one element
    array keeps one evaluation per row.
    """
    return df.select("*", F.explode(F.array_compact(F.array(col))).alias(alias))


def strip_ws(col) -> Column:
    """``str.strip()``: remove Unicode whitespace from both ends."""
    return F.btrim(_c(col), F.lit(python_whitespace()))


def fold_ascii(col) -> Column:
    """ASCII transliteration; unmapped characters are preserved.

    One ``translate`` for single-character folds; the few multi-character
    folds run only on rows that contain one of their source characters.
    Pass a column reference (not a large expression): it is used twice.
    """
    src, dst, multi = fold_tables()
    return fold_multi(F.translate(_c(col), src, dst))


def fold_multi(col) -> Column:
    """The multi-character part of ``fold_ascii`` (applied after translate)."""
    _, _, multi = fold_tables()
    c = _c(col)
    replaced = c
    for ch, rep in multi:
        replaced = F.replace(replaced, F.lit(ch), F.lit(rep))
    guard = "[" + "".join(ch for ch, _ in multi) + "]"
    return F.when(c.rlike(guard), replaced).otherwise(c)


def with_normalized(df, text_col: str = "content"):
    """Add ``stripped``, ``folded`` and ``lowered`` columns.

    Pure-ASCII texts (character count equals byte count, both O(1) or a
    byte scan) skip transliteration entirely.  The others run one
    ``translate`` bound once per row, then the multi-character folds.
    """
    src, dst, _ = fold_tables()
    ascii_only = F.length("stripped") == F.octet_length("stripped")
    folded = F.when(ascii_only, F.col("stripped")).otherwise(
        bind(F.translate(F.col("stripped"), src, dst), fold_multi))
    return (df.withColumn("stripped", strip_ws(text_col))
              .withColumn("folded", folded)
              .withColumn("lowered", F.lower("folded")))


def parse_message_link(col) -> Column:
    """First ``/guild/channel/message`` id triple; ids beyond 64 bits -> null.

    ``matched`` is false when no link pattern is present at all.
    """
    c = _c(col)
    part = lambda i: F.regexp_extract(c, LINK_PATTERN, i)
    return F.struct(
        c.rlike(LINK_PATTERN).alias("matched"),
        F.when(c.rlike(LINK_PATTERN), part(1).try_cast("bigint")).alias("guild_id"),
        F.when(c.rlike(LINK_PATTERN), part(2).try_cast("bigint")).alias("channel_id"),
        F.when(c.rlike(LINK_PATTERN), part(3).try_cast("bigint")).alias("message_id"),
    )


def choice_number(col, n: int) -> Column:
    """Trimmed all-digit text in ``1..n`` as int, else null (invalid input)."""
    t = strip_ws(col)
    num = t.try_cast("int")
    return F.when(t.rlike("^[0-9]+$") & num.between(1, n), num)


def decode_choice(col, codes: dict[int, str]) -> Column:
    """Map a valid choice to its category label (null when invalid)."""
    n = max(codes)
    m = F.create_map(*[x for k in sorted(codes) for x in (F.lit(k), F.lit(codes[k]))])
    return F.try_element_at(m, choice_number(col, n))
