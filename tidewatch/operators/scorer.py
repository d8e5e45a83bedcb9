"""A word scorer fitted on labelled posts (scorer of the cascade, O-D1).

Each word weighs its smoothed log-odds between abusive and other posts, in
thousandths; a text scores the mean weight of its distinct words, mapped to
0..1.  Fitting and scoring are plain aggregates and one join by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = "[a-z]+"
MODEL_ATTRIBUTE = "TOXICITY"


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))


def fit_word_weights(posts: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``word``, ``weight``: round(1000 ln of the odds ratio), add-one
    smoothed, from all posts with a label.  A word that every second post
    holds is counted per task before the shuffle."""
    words = posts.where(F.col(label_col).isNotNull()).select(
        F.explode(distinct_words(F.coalesce(F.col(text_col), F.lit("")))).alias("word"), F.col(label_col).alias("_y"))
    counts = words.groupBy("word").agg(F.count_if("_y").alias("pos"), F.count_if(~F.col("_y")).alias("neg"))
    total = counts.agg(F.sum("pos"), F.sum("neg"), F.count("*")).first()
    p, n, v = (x or 0 for x in total)
    base = math.log((n + v) / (p + v)) if v else 0.0
    odds = F.log((F.col("pos") + 1).cast("double") / (F.col("neg") + 1).cast("double")) + F.lit(base)
    return counts.select("word", F.round(odds * 1000).cast("bigint").alias("weight"))


def score_texts(rows: DataFrame, weights: DataFrame, id_col: str, text_col: str, out: str = "score") -> DataFrame:
    """``id_col``, ``out``: 0.5 for a text without known words."""
    words = rows.select(F.col(id_col).alias("_id"), F.explode(distinct_words(F.col(text_col))).alias("word"))
    sums = words.join(weights, "word").groupBy("_id").agg(F.sum("weight").alias("_w"), F.count("*").alias("_n"))
    logit = F.col("_w").cast("double") / (F.col("_n") * 1000).cast("double")
    return (rows.select(id_col).join(sums, F.col(id_col) == F.col("_id"), "left")
            .select(id_col, F.round(F.coalesce(1 / (1 + F.exp(-logit * 10)), F.lit(0.5)), 6).alias(out)))


def word_scorer(weights: DataFrame, id_col: str = "message_id", text_col: str = "content"):
    """A scorer for ``evaluate``: the model's score as one attribute."""
    def scorer(df: DataFrame) -> DataFrame:
        scored = score_texts(df, weights, id_col, text_col, "_score")
        return (df.join(scored, id_col).withColumn("attr_scores", F.create_map(F.lit(MODEL_ATTRIBUTE), F.col("_score")))
                .withColumn("chat_content", F.lit(None).cast("string")).drop("_score"))
    return scorer
