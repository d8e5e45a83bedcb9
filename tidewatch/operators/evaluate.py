"""Classifier-quality measurement (O-A2, O-H1..H7).

Ranks and running totals over all rows are taken in blocks: each block is
ranked or summed on its own, and the totals of the blocks before are carried
over, so no task orders a whole class.  ``random_sample`` and an explicit
``n`` of ``balanced_pairs`` are top-n (every partition keeps its n best).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The label that marks a post as not abusive.
NEGATIVE_LABEL = "not_cyberbullying"
# A character that separates nothing: files hold no such control character.
NO_SEPARATOR = "\x01"
# The four ensemble variants, in reporting order.
ENSEMBLE_VARIANTS = [(0, "and"), (1, "attribute"), (2, "chat"), (3, "or")]


def parse_labeled_lines(df: DataFrame, col: str = "value",
                        negative: str = NEGATIVE_LABEL) -> DataFrame:
    """Split each line at its last comma into ``post`` and ``label``.

    Lines without a comma are dropped; positive = label != ``negative``.
    """
    v = F.col(col)
    label = F.substring_index(v, ",", -1)
    post = F.left(v, F.length(v) - F.length(label) - 1)
    return (df.where(v.contains(","))
              .withColumn("label", label).withColumn("post", post)
              .withColumn("is_positive", F.col("label") != F.lit(negative)))


def read_labeled_posts(spark, path: str, negative: str = NEGATIVE_LABEL,
                       header: bool = False, multiline: bool = False) -> DataFrame:
    """O-A2: files of ``post,label`` records, one per line.

    ``header=True`` skips the first line of each file (by default it is read
    as a post, like any other line).  Line ends (``\\n`` or ``\\r\\n``) are
    removed.  ``multiline=True`` reads quoted CSV whose posts may hold line
    ends.
    """
    if multiline:
        rows = spark.read.csv(path, schema="post string, label string", header=header, multiLine=True, escape='"')
        return rows.where("label is not null").withColumn("is_positive", F.col("label") != F.lit(negative))
    # the reader itself skips each file's first line; a separator that no
    # text holds keeps every line whole
    lines = spark.read.csv(path, schema="value string", header=header, sep=NO_SEPARATOR, quote="", escape="",
                           ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True)
    return parse_labeled_lines(lines, "value", negative).select("post", "label", "is_positive")


def hash_key(id_col: str, seed: int) -> Column:
    """Seeded shuffle order: 60 bits of an MD5 hash of id and seed."""
    text = F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def drop_failed(preds: DataFrame, score_cols: list[str]) -> DataFrame:
    """O-H7: evaluation skips any row whose scorer call failed (null)."""
    return preds.dropna(subset=score_cols)


def random_sample(posts: DataFrame, n: int, order: Column, id_col: str = "post_id") -> DataFrame:
    """O-H2: first ``n`` rows in a seeded shuffle order (top-n, no full sort)."""
    return posts.withColumn("_k", order).orderBy("_k", id_col).limit(n).drop("_k")


RANK_BITS, BIN_BITS = 60, 16
RUN_BLOCK = 4096


def balanced_pairs(posts: DataFrame, n: int | None, order: Column, id_col: str = "post_id",
                   label_col: str = "is_positive", carry: list[str] | None = None) -> DataFrame:
    """O-H1: pair the i-th positive with the i-th negative (at most ``n``
    pairs if given, else all).

    Pairs = min(#positive, #negative).  Output ``pair_idx, pos_id, neg_id``
    plus ``pos_<c>`` / ``neg_<c>`` for every carried column.  ``order`` is a
    uniform key of ``RANK_BITS`` bits: its leading bits are the block of a
    row, whose rank is its place there plus the size of the blocks before.
    """
    carry = carry or []
    keyed = posts.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_pos"), *carry, order.alias("_k"))
    if n is not None:
        keyed = (keyed.where("_pos").orderBy("_k", "_id").limit(n)
                 .unionByName(keyed.where("not _pos").orderBy("_k", "_id").limit(n)))
    keyed = keyed.withColumn("_bin", F.shiftright("_k", RANK_BITS - BIN_BITS))
    before = Window.partitionBy("_pos").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("_pos", "_bin").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_pos", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_pos", "_bin").orderBy("_k", "_id"))
    ranked = keyed.withColumn("_own", own).join(sizes, ["_pos", "_bin"]).withColumn("pair_idx", F.col("_own") + F.col("_before"))

    def side(flag: bool, prefix: str) -> DataFrame:
        return ranked.where(F.col("_pos") == F.lit(flag)).select(
            "pair_idx", F.col("_id").alias(f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in carry])

    return side(True, "pos").join(side(False, "neg"), "pair_idx")


def threshold_variants(scored: DataFrame, score_col: str, variants: dict[str, list],
                       id_col: str = "post_id") -> DataFrame:
    """O-H3: any-attribute-over-threshold prediction per threshold set."""
    from ..functions.replies import any_over
    preds = F.array(*[F.struct(F.lit(name).alias("variant"),
                               any_over(F.col(score_col), thr).alias("pred"))
                      for name, thr in variants.items()])
    return scored.select(id_col, F.inline(preds))


def ensemble_variants(preds: DataFrame, attr_col: str = "attr_pred",
                      chat_col: str = "chat_pred", keep: list[str] | None = None) -> DataFrame:
    """O-H4: four predictions per row: AND, attribute, chat, OR."""
    a, c = F.col(attr_col), F.col(chat_col)
    exprs = {0: a & c, 1: a, 2: c, 3: a | c}
    arr = F.array(*[F.struct(F.lit(i).alias("variant"), exprs[i].alias("pred"))
                    for i, _ in ENSEMBLE_VARIANTS])
    return preds.select(*(keep or []), F.inline(arr))


def confusion(preds: DataFrame, by: list[str], pred_col: str = "pred",
              label_col: str = "is_positive") -> DataFrame:
    """O-H5: tp, fp, tn, fn per group (partial aggregation before shuffle)."""
    p, y = F.col(pred_col), F.col(label_col)
    return preds.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))


def running_confusion(pair_preds: DataFrame, every: int = 50) -> DataFrame:
    """O-H6: cumulative counters after each pair, kept whenever the total
    number of judged posts is a multiple of ``every``.

    ``pair_preds(variant, pair_idx, pos_pred, neg_pred)`` is summed in blocks
    of ``RUN_BLOCK`` pairs; the sums of the blocks before are carried over.
    """
    counters = {"tp": F.col("pos_pred"), "tn": ~F.col("neg_pred"), "fp": F.col("neg_pred"), "fn": ~F.col("pos_pred")}
    rows = pair_preds.select("variant", "pair_idx", F.floor((F.col("pair_idx") - 1) / RUN_BLOCK).alias("_blk"),
                             *[c.cast("int").alias(k) for k, c in counters.items()])
    sums = rows.groupBy("variant", "_blk").agg(*[F.sum(k).alias(k) for k in counters])
    before = Window.partitionBy("variant").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("variant", "_blk", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in counters])
    upto = Window.partitionBy("variant", "_blk").orderBy("pair_idx").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(carry, ["variant", "_blk"]).select(
        "variant", "pair_idx", *[(F.col(f"_{k}") + F.sum(k).over(upto)).alias(k) for k in counters])
    return run.where(((F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")) % every) == 0)
