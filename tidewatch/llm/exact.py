"""Exact duplicate removal by sorting whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, ascii_lower, partitions, read_table

SPLIT_CHARS = 64
#: A key with more rows than this share of an average partition is split.
SHARE = 4


def hot_openings(base: DataFrame, scratch: Scratch, n: int) -> tuple[DataFrame, DataFrame]:
    """Openings, and texts (opening, hash), with more than 1/(``SHARE`` n) of
    all rows, each with the number of parts to split it into. Less than
    ``SHARE`` n keys can have so many rows, which bounds both tables."""
    counts = scratch.put(base.groupBy("lead", "h").agg(F.count("*").alias("n")), "counts")
    limit = max((counts.agg(F.sum("n")).first()[0] or 0) // (SHARE * n), 1)
    parts = F.ceil(F.col("n") / limit)
    texts = counts.where(F.col("n") > limit).select("lead", "h", parts.alias("text_parts"))
    leads = counts.groupBy("lead").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("lead", parts.alias("lead_parts"))
    return leads, texts


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """One row per input row with the survivor of its group of equal texts.

    Texts are equal when identical after lower-casing A-Z. The rows are
    range-partitioned by sampled splitters over the leading ``split_chars``
    of the text, then sorted by the whole text on disk, where equal texts are
    neighbours; each row is compared in full with the row before it.

    An opening measured as hot (``hot_openings``) is dealt by a hash of the
    whole text too, so its equal texts stay neighbours. Only a text that is
    hot itself is dealt by the identifier: its runs are sorted once more, one
    row for each, and neighbouring heads are compared in full.

    Columns: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    Null texts count as empty and are equal to each other. Of repeated rows
    with one id each is counted and they share the decision. A null id is
    kept only if all of its group are null. An empty table gives an empty
    result.
    """
    spark = df.sparkSession
    n = partitions(spark)
    best = F.min if keep == "smallest" else F.max
    scratch = Scratch(spark, "exact")
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select(
        "id", F.substring(ascii_lower(F.substring("t", 1, split_chars)), 1, split_chars).alias("lead"), ascii_lower(F.col("t")).alias("norm"))
    base = base.withColumn("h", F.xxhash64("norm"))
    leads, texts = hot_openings(base, scratch, n)
    dealt = base.join(F.broadcast(leads), "lead", "left").join(F.broadcast(texts), ["lead", "h"], "left")
    salt = (F.when(F.col("text_parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("text_parts")))
            .when(F.col("lead_parts").isNotNull(), F.pmod(F.col("h"), F.col("lead_parts"))).otherwise(F.lit(0)))
    dealt = dealt.select("id", "lead", "norm", "h", F.col("text_parts").isNotNull().alias("hot"), salt.alias("salt"))

    order = Window.partitionBy("lead", "salt").orderBy("norm")
    first = (F.row_number().over(order) == 1) | (F.lag("norm").over(order) != F.col("norm"))
    run = Window.partitionBy("lead", "salt", "run")
    rows = (dealt.repartitionByRange(n, "lead", "salt").withColumn("first", first)
            .withColumn("run", F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .select("id", "lead", "h", "hot", "salt", "run", F.when(F.col("hot") & F.col("first"), F.col("norm")).alias("head"),
                    F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
            .withColumn("keep_id", best("id").over(run)).withColumn("group_size", F.count("*").over(run)))
    rows = scratch.put(rows, "rows")

    # runs of one hot text lie in several parts: their heads are neighbours here
    key = ["lead", "h", "salt", "run"]
    heads = rows.where(F.col("head").isNotNull()).select(*key, "head", "keep_id", "group_size")
    order = Window.partitionBy("lead", "h").orderBy("head")
    heads = heads.withColumn("first", (F.row_number().over(order) == 1) | (F.lag("head").over(order) != F.col("head")))
    heads = heads.withColumn("class", F.sum(F.col("first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("lead", "h", "class")
    heads = heads.select(*key, best("keep_id").over(whole).alias("keep_id"), F.sum("group_size").over(whole).alias("group_size"))
    hot = rows.where("hot").drop("keep_id", "group_size").join(heads, key)
    out = ["id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return rows.where("not hot").select(*out).unionByName(hot.select(*out))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("id", "doc_id")


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
