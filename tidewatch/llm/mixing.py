"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, Scratch, read_table

RANK_BINS = 65536
BIN_BLOCK = 256
WEIGHTS = (5, 2, 1)
CAP = 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of the sources (``source``, ``source_size``), one row each.

    Sources in code point order (null last) get the weights in turn and share
    the total by weight; no target passes ``cap`` times its source, the excess
    goes to the others by weight. In order of size per weight the capped
    sources come first, so the common level is the largest of the levels
    that assume the first k sources capped.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("pos", F.row_number().over(turn)).withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "pos")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    s = s.withColumn("level", (total - capped).cast("double") / F.sum("weight").over(after).cast("double"))
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least((F.col("source_size") * cap).cast("double"),
                                                     F.col("level") * F.col("weight")).alias("target"))


def cut_by_rank(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """Where the words of a source, in order of rank, pass its ``rest``.

    ``ranked`` has ``source``, ``rest``, ``bin``, ``rank``, ``id`` and
    ``size``; bins are in order of rank. Words are counted per bin, and only
    the bin that holds the cut is ordered row by row. Columns: ``source``,
    ``cut_bin``, ``last`` (rank and id of the last document of that bin that
    fits) and ``filled`` (words up to there). A source that fits whole has
    no row.
    """
    bins = ranked.groupBy("source", "rest", "bin").agg(F.sum("size").alias("words"))
    # the cut by blocks of bins first, then by the bins of its block
    bins = bins.withColumn("block", F.floor(F.col("bin") / BIN_BLOCK))
    blocks = bins.groupBy("source", "rest", "block").agg(F.sum("words").alias("words"))
    upto = Window.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("cum", F.sum("words").over(upto)).where(F.col("cum") > F.col("rest"))
    blocks = blocks.groupBy("source").agg(F.min_by(F.struct("block", (F.col("cum") - F.col("words")).alias("before")), "block").alias("cut"))
    inner = Window.partitionBy("b.source").orderBy("b.bin")
    cut = (bins.alias("b").join(blocks.alias("k"), F.col("b.source").eqNullSafe(F.col("k.source")) & (F.col("b.block") == F.col("k.cut.block")))
           .select(F.col("b.source").alias("source"), "b.rest", "b.bin", "b.words", (F.col("k.cut.before") + F.sum("b.words").over(inner)).alias("cum"))
           .where(F.col("cum") > F.col("rest"))
           .groupBy("source").agg(F.min_by(F.struct("bin", (F.col("cum") - F.col("words")).alias("cum")), "bin").alias("cut")))
    cut = scratch.put(cut.select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.cum").alias("cut_cum")), "cut")

    by_rank = Window.partitionBy("r.source").orderBy("r.rank", "r.id")
    edge = (ranked.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
                                   & (F.col("r.bin") == F.col("c.cut_bin")))
            .withColumn("cum", F.col("c.cut_cum") + F.sum("r.size").over(by_rank))
            .where(F.col("cum") <= F.col("r.rest"))
            .groupBy(F.col("r.source").alias("source"))
            .agg(F.max(F.struct(F.col("r.rank").alias("rank"), F.col("r.id").alias("id"))).alias("last"), F.max("cum").alias("cum")))
    c, e = cut.alias("c"), edge.alias("e")
    return scratch.put(c.join(e, F.col("c.source").eqNullSafe(F.col("e.source")), "left").select(
        "c.source", "c.cut_bin", "e.last", F.coalesce("e.cum", "c.cut_cum").alias("filled")), "edge")


def before_cut() -> Column:
    """Whether a row joined with its source's cut lies before it."""
    own = F.struct("rank", "id")
    return F.coalesce((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (own <= F.col("last"))), F.lit(False))


def fill_gaps(undrawn: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents (``source``, ``id``) that fill what the first cut leaves.

    ``undrawn`` has the rows that are not drawn with ``gap``, the words their
    source still lacks. Going on down the rank, each document that fits is
    taken: all that fit at the start of a round come up to the next cut,
    which makes the gap smaller than the document there, until none fits.
    Then the document left that closes the gap best is added. Rows that
    repeat an id are one document.
    """
    # uniform numbers give even bins and the order of the ranks
    units = undrawn.groupBy("source", "id", F.col("u").alias("rank"), "gap").agg(F.sum("size").alias("size")).where("size > 0 and gap > 0")
    units = units.withColumn("bin", F.floor(F.col("rank") * RANK_BINS))
    left = scratch.put(units.where("size <= gap").withColumnRenamed("gap", "rest"), "left")
    taken = left.limit(0).select("source", "id", "size")
    while not left.isEmpty():
        cut = cut_by_rank(left, scratch)
        step = (left.alias("l").join(cut.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source")), "left")
                .select("l.*", "c.cut_bin", "c.last", "c.filled")
                .withColumn("drawn", F.col("cut_bin").isNull() | before_cut()).withColumn("rest", F.col("rest") - F.col("filled")))
        step = scratch.put(step.where("drawn or size <= rest").select("source", "id", "rank", "bin", "size", "rest", "drawn"), "step")
        taken = taken.union(step.where("drawn").select("source", "id", "size"))
        left = step.where("not drawn").drop("drawn")
    taken = scratch.put(taken, "taken")
    filled = taken.groupBy("source").agg(F.sum("size").alias("filled"))
    gap = F.col("n.gap") - F.coalesce("f.filled", F.lit(0))
    close = (units.alias("n").join(filled.alias("f"), F.col("n.source").eqNullSafe(F.col("f.source")), "left")
             .where(F.abs(F.col("n.size") - gap) < gap).select("n.source", "n.id", "n.rank", F.abs(F.col("n.size") - gap).alias("miss")).alias("n")
             .join(taken.alias("t"), F.col("n.source").eqNullSafe(F.col("t.source")) & F.col("n.id").eqNullSafe(F.col("t.id")), "left_anti")
             .groupBy("source").agg(F.min(F.struct("miss", "rank", "id")).alias("close")))
    return scratch.put(taken.select("source", "id").union(close.select("source", "close.id")), "filling")


def pareto_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 1) -> DataFrame:
    """Copies of each document so that every source takes about its target.

    A document of a source with target / size = k + f is taken k times for
    certain; the rest of the target is a sample of fixed size in words with
    inclusion probability f, drawn by Pareto order sampling: documents are
    ranked by the odds of a uniform number (a hash of seed and id) divided by
    the odds of f, and taken in that order while they fit. A document that
    does not fit is passed over, and the sample goes on down the rank until
    no document fits; a document so long that the others cannot reach the
    target without it comes before them. The one document left that closes
    the remaining gap best is added.

    Ranks are never sorted per source: words are counted per rank bin, and
    only the bin that holds the cut is ordered row by row, so a source with
    most of the rows is spread over all tasks.

    Columns: ``id``, ``source``, ``size``, ``source_size``, ``target``,
    ``copies``, ``taken``. Null texts have size 0, a null source is a source
    of its own, rows that repeat an id in one source share the decision; an
    empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.put(df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.greatest("source_size", F.lit(1)).cast("double")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(epochs)).withColumn("part", epochs - F.col("whole")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = scratch.put(targets, "targets")

    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")
    u = (draw.cast("double") + 0.5) / F.lit(float(1 << 52))
    p = F.greatest(F.least(F.col("part"), F.lit(1 - 1e-9)), F.lit(1e-9))
    ranked = (rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
              .select("r.id", "r.source", "r.size", "t.source_size", "t.target", "t.whole", "t.rest",
                      u.alias("u"), p.alias("p"))
              .withColumn("rank", F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
              .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * RANK_BINS)))
    needed = ranked.where((F.col("size") > F.col("source_size") - F.col("rest")) & (F.col("size") <= F.col("rest")))
    needed = scratch.put(needed.select("source", "id").distinct().withColumn("needed", F.lit(True)), "needed")
    ranked = (ranked.alias("r").join(needed.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source")) & F.col("r.id").eqNullSafe(F.col("n.id")), "left")
              .select("r.*", "n.needed").withColumn("u", F.col("u") - F.when(F.col("needed"), 1).otherwise(0))
              .withColumn("rank", F.when(F.col("needed"), F.col("u")).otherwise(F.col("rank")))
              .withColumn("bin", F.when(F.col("needed"), F.floor(F.col("u") * RANK_BINS)).otherwise(F.col("bin"))))

    cut = cut_by_rank(ranked, scratch)
    joined = (ranked.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left")
              .select("r.*", "c.cut_bin", "c.last", "c.filled"))
    joined = joined.withColumn("drawn", before_cut())
    gap = F.col("rest") - F.col("filled")
    more = fill_gaps(joined.where(~F.col("drawn")).withColumn("gap", gap), scratch).withColumn("more", F.lit(True))
    copies = F.col("j.whole") + (F.col("j.drawn") | F.coalesce(F.col("m.more"), F.lit(False))).cast("long")
    return (joined.alias("j").join(more.alias("m"), F.col("j.source").eqNullSafe(F.col("m.source")) & F.col("j.id").eqNullSafe(F.col("m.id")), "left")
            .select("j.id", "j.source", "j.size", "j.source_size", "j.target", copies.alias("copies"),
                    (copies * F.col("j.size")).alias("taken")))


def op5_mix_sources(spark, sf_dir):
    return pareto_mix(read_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((pos - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / weight, pos)),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, max(lev) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS epochs FROM t),
p AS (
  SELECT *, floor(epochs)::BIGINT AS whole, greatest(least(epochs - floor(epochs), (1 - 1e-9)::DOUBLE), 1e-9::DOUBLE) AS prob,
         target - floor(epochs)::BIGINT * source_size AS rest FROM e),
u AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.rest, p.prob,
         (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
n AS (SELECT *, u - CASE WHEN size > source_size - rest AND size <= rest THEN 1 ELSE 0 END AS place FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place, doc_id) AS k FROM n),
walk AS (
  SELECT source, 0::BIGINT AS k, 0::BIGINT AS filled, NULL::BIGINT AS doc_id, false AS drawn FROM p
  UNION ALL
  SELECT r.source, r.k, w.filled + CASE WHEN r.size <= r.rest - w.filled THEN r.size ELSE 0 END, r.doc_id, r.size <= r.rest - w.filled
  FROM walk w JOIN r ON r.source IS NOT DISTINCT FROM w.source AND r.k = w.k + 1),
g AS (
  SELECT r.*, w.drawn, r.rest - max(w.filled) OVER (PARTITION BY r.source) AS gap
  FROM r JOIN walk w ON w.source IS NOT DISTINCT FROM r.source AND w.k = r.k),
k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT drawn AND abs(size - gap) < gap THEN 0 ELSE 1 END, abs(size - gap), place, doc_id) = 1
            AND NOT drawn AND abs(size - gap) < gap AS closes FROM g)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN drawn OR closes THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM k
"""
