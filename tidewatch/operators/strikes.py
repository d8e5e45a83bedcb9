"""Rolling strike counts, escalation ladder and balances (O-G4..G7).

Semantics: a strike list per user, in action order; on each new strike the
head of the list is evicted while it is at least ``H`` days older (by report
creation time) than the new strike's report; then the strike is appended and
the list length is the count.  A strike exactly H days old is expired.
Strikes with a null key or time belong to nobody: their count is null.

Two modes:

* ``replay`` (default): the head-only eviction itself, exact for any arrival
  order.  A strike leaves with the first later one whose time is at least H
  after the largest time up to it: earlier heads with larger times hold it
  back, and whatever moves them moves it too.  So with P the running maximum
  of the times, the list after strike i holds the strikes j <= i with
  P(j) > P(i) - H.  Running maxima, positions and the last strike gone are
  taken in blocks and carried over, so a user with most of the strikes is
  split over many tasks.
* ``window``: for strikes that arrive in creation order.  Every strike adds
  one at its time and takes it back H later (before a strike at that very
  time), and the count is the running sum.  Sums are taken per block of time
  and carried over, so a user with most of the rows is split.

Strikes of a user with the same sequence number are ordered by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

DAY_US = 86_400_000_000
TIME_BLOCKS = 64        # blocks of a horizon in window mode
BLOCKS = 256            # blocks of the sequence, and of time, in replay mode


def _micros(col):
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def window_counts(df: DataFrame, keys: list[str], t_col: str, seq: str, h: int, out: str) -> DataFrame:
    """Rows of the same keys in ``(t - h, t]`` (integer time), ties counted in
    ``seq`` order, as a running sum of arrivals and expiries."""
    width = max(1, h // TIME_BLOCKS)
    own = df.withColumn("_at", F.col(t_col)).withColumn("_d", F.lit(1))
    gone = df.select(*keys, seq, (F.col(t_col) + h).alias("_at"), F.lit(-1).alias("_d"))
    both = own.unionByName(gone, allowMissingColumns=True).withColumn("_blk", F.floor(F.col("_at") / width))
    sums = both.groupBy(*keys, "_blk").agg(F.sum("_d").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"))
    # expiries first at one time, arrivals in order
    run = Window.partitionBy(*keys, "_blk").orderBy("_at", "_d", seq).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.join(carry, [*keys, "_blk"]).withColumn(out, F.col("_c") + F.sum("_d").over(run))
    return counted.where(F.col("_d") == 1).select(*df.columns, out)


def strikes_window(events: DataFrame, key: str, created: str, seq: str,
                   horizon_days: int, out: str = "n_strikes") -> DataFrame:
    """Active strikes after each strike event, by creation-time window."""
    t = events.withColumn("_t", _micros(created))
    known = window_counts(t.where(F.col(key).isNotNull()), [key], "_t", seq, horizon_days * DAY_US, out)
    rest = t.where(F.col(key).isNull()).withColumn(out, F.lit(None).cast("bigint"))
    return known.unionByName(rest).drop("_t")


def _block(col: str, edges: list[int]) -> Column:
    """Number of the block of ``col`` between sorted ``edges``: first among
    every sixteenth of them, then among the sixteen that follow."""
    step, last = 16, (1 << 63) - 1
    edges = edges + [last] * (-len(edges) % step)

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col(col)))

    if not edges:
        return F.lit(0)
    whole = F.expr(f"array({', '.join(f'{e}L' for e in edges)})")
    first = upto(F.expr(f"array({', '.join(f'{e}L' for e in edges[step - 1::step])})")) * step
    return first + upto(F.slice(whole, first + 1, step))


def _edges(rows: DataFrame, seq: str) -> tuple[list[int], list[int]]:
    """Sampled quantiles of the sequence, and of the times and expiries."""
    shares = F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)])
    found = rows.agg(*[F.percentile_approx(c, shares, 4 * BLOCKS) for c in (F.col(seq).cast("long"), F.col("_t"), F.col("_t") + F.col("_h"))]).first()
    order, times, expiries = (sorted(set(x or [])) for x in found)
    return order, sorted({*times[::2], *expiries[::2]})


def _running_max(rows: DataFrame, keys: list[str], seq: str, edges: list[int]) -> DataFrame:
    """Add ``_p``, the largest time up to each row, and ``_i``, its position,
    by (``seq``, ``_t``) within the keys."""
    rows = rows.withColumn("_blk", _block(seq, edges))
    sums = rows.groupBy(*keys, "_blk").agg(F.max("_t").alias("_top"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_blk", F.max("_top").over(earlier).alias("_top"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(seq, "_t")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_p", F.max("_t").over(upto)).withColumn("_i", F.row_number().over(inside))
            .join(sums, [*keys, "_blk"]).withColumn("_p", F.greatest("_p", "_top")).withColumn("_i", F.col("_i") + F.col("_n"))
            .drop("_blk", "_top", "_n"))


def replay_counts(rows: DataFrame, keys: list[str], seq: str, out: str) -> DataFrame:
    """Live strikes after each row, by head-only eviction; ``rows`` has
    non-null keys, ``_t`` and the horizon ``_h`` (one for each key), both in
    microseconds."""
    rows = stored(rows, "strikes")
    order, times = _edges(rows, seq)
    rows = _running_max(rows, keys, seq, order)
    # a value of the running maximum takes away all rows up to its last one, H later
    values = rows.groupBy(*keys, "_p", "_h").agg(F.max("_i").alias("_last"))
    gone = values.select(*keys, (F.col("_p") + F.col("_h")).alias("_at"), F.col("_last").alias("_gone"), F.lit(None).cast("long").alias("_p"))
    asked = values.select(*keys, F.col("_p").alias("_at"), F.lit(None).cast("long").alias("_gone"), "_p")
    both = gone.unionByName(asked).withColumn("_blk", _block("_at", times))
    tops = both.groupBy(*keys, "_blk").agg(F.max("_gone").alias("_before"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_blk", F.max("_before").over(earlier).alias("_before"))
    upto = Window.partitionBy(*keys, "_blk").orderBy("_at", F.col("_gone").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_gone", F.max("_gone").over(upto)).where(F.col("_p").isNotNull()).join(tops, [*keys, "_blk"])
    found = found.select(*keys, "_p", F.coalesce(F.greatest("_gone", "_before"), F.lit(0)).alias("_gone"))
    counted = rows.join(found, [*keys, "_p"]).withColumn(out, F.col("_i") - F.col("_gone"))
    return counted.drop("_p", "_i", "_gone", "_t", "_h")


def strikes_replay(events: DataFrame, key: str, created: str, seq: str,
                   horizon_days: int, out: str = "n_strikes") -> DataFrame:
    """Active strikes after each strike event, by literal head-only eviction."""
    t = events.withColumn("_t", _micros(created)).withColumn("_h", F.lit(horizon_days * DAY_US))
    mine = F.col(key).isNotNull() & F.col("_t").isNotNull()
    known = replay_counts(t.where(mine), [key], seq, out)
    rest = t.where(~mine).drop("_t", "_h").withColumn(out, F.lit(None).cast("bigint"))
    return known.unionByName(rest)


def strikes(events: DataFrame, key: str, created: str, seq: str, horizon_days: int,
            mode: str = "replay", out: str = "n_strikes") -> DataFrame:
    """O-G4 / O-G5 dispatcher."""
    if mode == "window":
        return strikes_window(events, key, created, seq, horizon_days, out)
    if mode == "replay":
        return strikes_replay(events, key, created, seq, horizon_days, out)
    raise ValueError(f"unknown strike mode {mode!r}")


def multi_horizon_strikes(df: DataFrame, kinds: dict[str, tuple], seq: str, created: str,
                          out: str = "n_strikes", mode: str = "replay") -> DataFrame:
    """Several strike kinds (each its own key and horizon) in one pass.

    ``kinds = {name: (condition Column, key Column, horizon_days)}``.  Only
    kind, key, time and ``seq`` go through the count; the result is attached
    by all four (strikes equal in all of them get the count after the last
    one).  Adds ``strike_kind`` and ``out`` (null for rows of no kind).
    """
    kind, key, h = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for name, (cond, k, d) in reversed(list(kinds.items())):
        kind = F.when(cond, F.lit(name)).otherwise(kind)
        key = F.when(cond, k.cast("bigint")).otherwise(key)
        h = F.when(cond, F.lit(d * DAY_US)).otherwise(h)
    df = df.withColumn("_key", F.when(kind.isNotNull(), key)).withColumn("_t", _micros(created))
    df = df.withColumn("strike_kind", F.when(F.col("_key").isNotNull() & F.col("_t").isNotNull(), kind))
    slim = df.select(F.col(seq).alias("_seq"), "strike_kind", "_key", "_t", F.col("_t").alias("_time"),
                     h.alias("_h")).where("strike_kind is not null and _key is not null and _t is not null")
    if mode == "replay":
        counted = replay_counts(slim, ["strike_kind", "_key"], "_seq", out)
    else:
        counted = None
        for name, (_, _, d) in kinds.items():
            one = window_counts(slim.where(F.col("strike_kind") == name).drop("_h"), ["_key"], "_t", "_seq", d * DAY_US, out)
            one = one.drop("_t")
            counted = one if counted is None else counted.unionByName(one)
    counted = counted.groupBy(F.col("_seq").alias(seq), "strike_kind", "_key", F.col("_time").alias("_t")).agg(F.max(out).alias(out))
    return df.join(counted, [seq, "strike_kind", "_key", "_t"], "left").drop("_key", "_t")


# Escalation outcomes.
ABUSE_SLOWED, ABUSE_WARNED, ABUSE_BANNED = "slowed", "warned", "banned"
FALSE_STRUCK, FALSE_RESTRICTED = "struck", "restricted"
LARGE_STRIKE_EMOJI = "‼️"


def abuse_ladder(n, emoji):
    """O-G6 (abuse): 2 strikes on a large account -> slowed; <3 -> warned;
    otherwise banned (the report's banned flag is set)."""
    return (F.when((n == 2) & (emoji == F.lit(LARGE_STRIKE_EMOJI)), F.lit(ABUSE_SLOWED))
            .when(n < 3, F.lit(ABUSE_WARNED)).otherwise(F.lit(ABUSE_BANNED)))


def false_report_ladder(n):
    """O-G6 (false reports): <3 -> struck (flag set); else restricted."""
    return F.when(n < 3, F.lit(FALSE_STRUCK)).otherwise(F.lit(FALSE_RESTRICTED))


def strike_balance(users: DataFrame, strike_events: DataFrame, user_key: str, created: str,
                   as_of, horizon_days: int, out: str) -> DataFrame:
    """O-G7: active strikes per user at ``as_of`` (0 when none).

    A strike is active when it is less than H days old at ``as_of`` (future
    strikes count).  Aggregated per user before the join (partial
    aggregation map-side, so a user with many strikes is combined early).
    """
    age_ok = (F.timestamp_diff("MICROSECOND", F.col(created).cast("timestamp_ntz"),
                               as_of.cast("timestamp_ntz")) < F.lit(horizon_days * DAY_US))
    active = (strike_events.groupBy(F.col(user_key).alias("_u"))
              .agg(F.count_if(age_ok).alias(out)))
    return (users.join(active, users[user_key] == active["_u"], "left").drop("_u")
                 .withColumn(out, F.coalesce(F.col(out), F.lit(0))))


def strike_balance_replay(users: DataFrame, strike_events: DataFrame, user_key: str,
                          created: str, seq: str, as_of: str, horizon_days: int,
                          out: str) -> DataFrame:
    """O-G7 in replay mode: the list left after replaying every strike in
    action order and evicting expired heads at ``as_of`` (a timestamp
    literal); 0 for users without strikes.  A look-up evicts like a strike
    at its time: the strikes whose running maximum lies within the horizon of
    the largest time of all are left."""
    rows = strike_events.where(F.col(user_key).isNotNull()).select(
        F.col(user_key).alias("_k"), F.col(seq).alias("_seq"), _micros(created).alias("_t"), F.lit(horizon_days * DAY_US).alias("_h")).where("_t is not null")
    rows = stored(rows, "strikes")
    order, _ = _edges(rows, "_seq")
    ends = rows.groupBy("_k").agg(F.greatest(F.max("_t"), _micros(F.lit(as_of))).alias("_end"))
    live = _running_max(rows, ["_k"], "_seq", order).join(ends, "_k").groupBy("_k").agg(
        F.count_if(F.col("_p") > F.col("_end") - F.col("_h")).alias("_n"))
    return (users.join(live, users[user_key] == live["_k"], "left").drop("_k")
                 .withColumn(out, F.coalesce("_n", F.lit(0))).drop("_n"))
