"""Term and pattern matching (theta joins between messages and lists).

A list that the caller holds, or a term table of checked size (at most
``SMALL_TABLE`` terms and ``SMALL_BYTES`` bytes), is broadcast: blocks of at most ``TERM_BLOCK`` terms,
each one Aho-Corasick automaton on the executors, and every text is scanned
once per block in Arrow batches.  A larger term table stays in Spark and is
joined through an index of rarest grams (``term_index``); both give the same
hits.  Patterns stay JVM
regular expressions, ``PATTERN_BLOCK`` at a time behind one alternation.

A hit is ``struct(item, start, end)`` with 0-based, end-exclusive offsets
into the matched text.  Among several hits the first is the one that starts
earliest, then the longest, then the alphabetically smallest.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, present, strip_ws
from .term_index import hits_indexed, match_indexed

TERM_BLOCK = 100_000    # terms of one broadcast block and automaton
SMALL_TABLE = 200_000   # terms of a table that is broadcast, at most,
SMALL_BYTES = 32 << 20  # and their bytes
PATTERN_BLOCK = 100     # patterns of one alternation

HIT_TYPE = "struct<item:string,start:int,end:int>"
_CANDIDATE = "struct<pos:int,neg_len:int,item:string>"


# ---------------------------------------------------------------- lists ----

def clean_terms(df: DataFrame, col: str = "term", fold: bool = False) -> DataFrame:
    """Strip and lower terms and drop blank ones (an empty term would match
    every message).  ``fold=True`` also transliterates terms like message
    text, so an accented term can match (by default it cannot, as in the
    reference)."""
    t = strip_ws(F.col(col))
    if fold:
        from ..functions.text import fold_ascii
        t = fold_ascii(t)
    t = F.lower(t)
    return df.select(t.alias("term")).where(F.length("term") > 0)


def load_terms(df: DataFrame, col: str = "term", fold: bool = False) -> DataFrame:
    """Clean a user term list (``clean_terms``) and drop repeats."""
    return clean_terms(df, col, fold).distinct()


def terms_frame(spark, terms: list[str]) -> DataFrame:
    """A term DataFrame from a Python list (cleaned like ``load_terms``)."""
    return load_terms(spark.createDataFrame([(t,) for t in terms], "term string"))


def invalid_patterns(spark, patterns: list[str]) -> list[str]:
    """Patterns the JVM regex engine cannot compile, in their order.

    The driver's JVM compiles each one: no job runs, so a lost executor or
    any other failure is never taken for a bad pattern.
    """
    from pyspark.errors import IllegalArgumentException   # a PatternSyntaxException is one
    java = spark._jvm.java.util.regex
    bad = []
    for p in patterns:
        try:
            java.Pattern.compile(p)
        except IllegalArgumentException:
            bad.append(p)
    return bad


def validate_patterns(spark, patterns: list[str]) -> list[str]:
    """Reject patterns the JVM regex engine cannot compile (fail fast), so a
    bad pattern fails at registration instead of every later evaluation."""
    bad = invalid_patterns(spark, patterns)
    if bad:
        raise ValueError(f"invalid regular expressions: {bad!r}")
    return patterns


# --------------------------------------------------------- term matching ----

def small_terms(spark, terms, fold: bool = False) -> list[str] | None:
    """The cleaned terms of a list, or of a table if they are few and short;
    None for a larger table, of which nothing is collected.  A list is
    cleaned by the same expressions, without a shuffle."""
    if isinstance(terms, DataFrame):
        clean = load_terms(terms, fold=fold).persist(StorageLevel.DISK_ONLY)   # it may be large
        try:
            count, size = clean.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
            small = count <= SMALL_TABLE and size <= SMALL_BYTES
            return sorted(r[0] for r in clean.collect()) if small else None
        finally:
            clean.unpersist()
    given = spark.createDataFrame(pa.table({"term": pa.array(sorted(set(terms)), pa.string())}))
    return sorted({r[0] for r in clean_terms(given, fold=fold).collect()})


def term_blocks(spark, clean: list[str]) -> list:
    """Broadcast blocks of a cleaned Python list of terms."""
    from ..session import ship_package
    ship_package(spark)
    return [spark.sparkContext.broadcast(clean[lo:lo + TERM_BLOCK]) for lo in range(0, len(clean), TERM_BLOCK)]


@functools.lru_cache(maxsize=8)
def _automaton(block):
    """The automaton of a broadcast block, built once per Python worker."""
    a = ahocorasick.Automaton()
    for t in block.value:
        a.add_word(t, t)
    a.make_automaton()
    return a, max(map(len, block.value))


def _alone(text: str, start: int, end: int) -> bool:
    """Whether no letter, digit or underscore touches ``text[start:end]``."""
    return not any(c == "_" or c.isalnum() for c in (text[start - 1:start] + text[end:end + 1]))


def _occurrences(text: str, automaton, whole_word: bool):
    for last, term in automaton.iter(text):
        start = last + 1 - len(term)
        if not whole_word or _alone(text, start, last + 1):
            yield start, term


def earliest_hit(text: str | None, automaton, longest: int, whole_word: bool):
    """(start, -length, term) of the first occurrence, or None; the scan
    stops where no later end can belong to an earlier start."""
    best = None
    for last, term in automaton.iter(text or ""):
        if best is not None and last - longest + 1 > best[0]:
            break
        start = last + 1 - len(term)
        if not whole_word or _alone(text, start, last + 1):
            hit = (start, -len(term), term)
            if best is None or hit < best:
                best = hit
    return best


def _first_udf(block, whole_word: bool):
    @F.arrow_udf(_CANDIDATE)
    def first(texts: pa.Array) -> pa.Array:
        automaton, longest = _automaton(block)
        hits = (earliest_hit(t, automaton, longest, whole_word) for t in texts.to_pylist())
        rows = [h and {"pos": h[0] + 1, "neg_len": h[1], "item": h[2]} for h in hits]
        return pa.array(rows, pa.struct([("pos", pa.int32()), ("neg_len", pa.int32()), ("item", pa.string())]))
    return first


def _all_udf(block, whole_word: bool):
    @F.arrow_udf(f"array<{HIT_TYPE}>")
    def every(texts: pa.Array) -> pa.Array:
        automaton, _ = _automaton(block)
        rows = []
        for t in texts.to_pylist():
            seen: dict[str, int] = {}
            for start, term in _occurrences(t or "", automaton, whole_word):
                if start < seen.get(term, start + 1):
                    seen[term] = start
            rows.append([{"item": term, "start": start, "end": start + len(term)} for term, start in seen.items()])
        return pa.array(rows, pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
    return every


def _best(cands: list[Column]) -> Column:
    """Smallest non-null candidate ``struct(pos, neg_len, item)`` as a hit.

    ``least`` skips nulls and compares structs field by field, so the choice
    (earliest, then longest, then smallest text) needs no lambda.
    """
    best = F.least(*cands) if len(cands) > 1 else cands[0]
    return F.when(best.isNotNull(), F.struct(
        best["item"].alias("item"),
        (best["pos"] - 1).alias("start"),
        (best["pos"] - 1 - best["neg_len"]).alias("end"),
    ))


def first_term_hit(text: Column, blocks: list, whole_word: bool = False) -> Column:
    """First blocked term that occurs in ``text`` (as a substring, or as a
    whole word when ``whole_word``); ``blocks`` from ``term_blocks``."""
    if not blocks:
        return F.lit(None).cast(HIT_TYPE)
    return _best([_first_udf(b, whole_word)(text) for b in blocks])


def all_term_hits(text: Column, blocks: list, whole_word: bool = False) -> Column:
    """Array of every term found in ``text`` (with its first offset)."""
    if not blocks:
        return F.array().cast(f"array<{HIT_TYPE}>")
    return F.concat(*[_all_udf(b, whole_word)(text) for b in blocks])


def first_pattern_hit(text: Column, patterns: list[str]) -> Column:
    """First pattern match; per block of patterns a combined alternation
    skips texts with none."""
    if not patterns:
        return F.lit(None).cast(HIT_TYPE)
    blocks = []
    for lo in range(0, len(patterns), PATTERN_BLOCK):
        own, cands = patterns[lo:lo + PATTERN_BLOCK], []
        for p in own:
            pos = F.regexp_instr(text, F.lit(p))
            cands.append(F.when(pos > 0, F.struct(
                pos.alias("pos"), (-F.length(F.regexp_substr(text, F.lit(p)))).alias("neg_len"),
                F.lit(p).alias("item"))))
        best = F.least(*cands) if len(cands) > 1 else cands[0]
        blocks.append(F.when(text.rlike("|".join(f"(?:{p})" for p in own)), best))
    return _best(blocks)


# ------------------------------------------------------ operators (C1-C5) ----

def match_terms(msgs: DataFrame, terms, text_col: str = "lowered",
                out: str = "term_hit", whole_word: bool = False, fold: bool = False) -> DataFrame:
    """O-C1: add the first blocked-term hit (null when none).

    ``terms`` is a Python list or a DataFrame with a ``term`` column (then
    ``msgs`` has a ``message_id``).
    ``whole_word`` requires non-letter/digit neighbours (option of Q2);
    ``fold`` folds terms like text (option of Q8).
    """
    small = small_terms(msgs.sparkSession, terms, fold)
    if small is None:
        return match_indexed(msgs, load_terms(terms, fold=fold), text_col, out, whole_word)
    return msgs.withColumn(out, first_term_hit(F.col(text_col), term_blocks(msgs.sparkSession, small), whole_word))


def term_hits(msgs: DataFrame, terms, text_col: str = "lowered", whole_word: bool = False,
              keep: list[str] | None = None) -> DataFrame:
    """O-C4: the (message, term) hit relation with each term's first offset.

    ``keep`` columns of the message row travel with each hit (no join back).
    """
    keep = keep or []
    small = small_terms(msgs.sparkSession, terms)
    if small is None:
        return hits_indexed(msgs, load_terms(terms), text_col, keep, whole_word)
    hits = all_term_hits(F.col(text_col), term_blocks(msgs.sparkSession, small), whole_word)
    return (msgs.select("message_id", *keep, F.explode(hits).alias("h"))
            .select("message_id", *keep, F.col("h.item").alias("term"),
                    F.col("h.start").alias("start"), F.col("h.end").alias("end")))


def match_regexes(msgs: DataFrame, patterns: list[str], text_col: str = "folded",
                  out: str = "regex_hit") -> DataFrame:
    """O-C2: first blocked pattern found in the (case-preserving) folded text."""
    pats = list(patterns)
    return msgs.withColumn(out, bind(text_col, lambda x: first_pattern_hit(x, pats)))


def any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found: ``first_pattern_hit`` without its place."""
    found = F.lit(False)
    for lo in range(0, len(patterns), PATTERN_BLOCK):
        own = patterns[lo:lo + PATTERN_BLOCK]
        single = functools.reduce(Column.__or__, [text.rlike(p) for p in own])
        found = found | (text.rlike("|".join(f"(?:{p})" for p in own)) & single)
    return F.coalesce(found, F.lit(False))


def unmatched(msgs: DataFrame, terms, patterns: list[str] | None = None) -> DataFrame:
    """O-C5: messages with neither a term nor a pattern hit.  No place of a
    pattern hit is looked for, and patterns only where no term is found."""
    miss = F.col("term_hit").isNull()
    if patterns:
        miss = miss & ~any_pattern(F.col("folded"), list(patterns))
    # (a generator: a filter would be pushed down and fold the text again)
    m = match_terms(msgs, terms).withColumn("_miss", F.when(miss, F.lit(True)))
    return present(m, "_miss", "_one").drop("term_hit", "_miss", "_one")
