"""Streaming operators.

* ``evaluate_stream``: the evaluation cascade per micro-batch
  (``foreachBatch``), fanned out to decisions, automatic reports and
  deletion notices; each batch overwrites only its own ``batch_id`` slice,
  so a batch replayed after a failure does not duplicate rows.
* ``strike_stream``: head-only strike eviction as keyed state
  (``applyInPandasWithState``); the state per user is only the live list.
* ``dialog_stream``: the report / list dialog as keyed state per author;
  the state is the open session only.  Link lookups are stream-static joins.
"""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import choice_number
from ..operators import decide as D
from ..operators import dialog as DG
from ..operators.strikes import DAY_US, _micros
from ..sources.io import batch_overwrite


def evaluate_stream(msgs: DataFrame, terms, patterns, pii_rules, scorer, out_dir: str,
                    checkpoint: str, trigger: dict | None = None):
    """Start the evaluation query; returns the StreamingQuery.

    ``terms`` / ``patterns`` may be callables returning the current lists
    (e.g. reading the list table): they are re-read for every micro-batch,
    so list edits take effect on the next batch, as in the live bot.
    """
    def current(x):
        return x() if callable(x) else x

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        dec = D.evaluate(batch, current(terms), current(patterns), pii_rules, scorer=scorer).persist()
        batch_overwrite(dec.select("message_id", "score", "reason", "stage"), f"{out_dir}/decisions", batch_id)
        batch_overwrite(D.auto_reports(dec), f"{out_dir}/reports", batch_id)
        batch_overwrite(D.deletions(dec), f"{out_dir}/notifications", batch_id)
        dec.unpersist()
    w = msgs.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def strike_stream(events: DataFrame, key: str, created: str, seq: str, horizon_days: int,
                  forget: bool = False) -> DataFrame:
    """Streaming O-G4/O-G5 (replay semantics): ``(k, seq, n_strikes)`` per event.

    A user's rows of a micro-batch are taken together and in action order.
    Ids travel as text, so 64-bit values stay exact; strikes without a key
    are left out, as in batch their count is null.  The state of a user is
    the live list.  With ``forget`` (for queries that run on; a query that
    ends with its input would wait for the timeouts) it is removed after
    ``horizon_days`` without a strike of the user: all in it has expired.
    """
    from ..session import ship_package
    ship_package(events.sparkSession)
    h = horizon_days * DAY_US
    slim = (events.where(F.col(key).isNotNull())
            .select(F.col(key).alias("k"), F.col(seq).cast("string").alias("seq"), _micros(created).cast("string").alias("t")))

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        live = deque(state.get[0]) if state.exists else deque()
        rows = sorted((int(s), int(t)) for pdf in pdfs for s, t in zip(pdf["seq"], pdf["t"]))
        counts = []
        for _, t in rows:
            while live and t - live[0] >= h:
                live.popleft()
            live.append(t)
            counts.append(len(live))
        state.update((list(live),))
        if forget:
            state.setTimeoutDuration(horizon_days * 86_400_000)
        yield pd.DataFrame({"k": pd.array([int(k[0])] * len(rows), "int64"), "seq": pd.array([s for s, _ in rows], "int64"), "n_strikes": counts})
    return slim.groupBy("k").applyInPandasWithState(
        fn, "k long, seq long, n_strikes long", "q array<long>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def dialog_stream(turns: DataFrame, guilds: DataFrame, chans: DataFrame, msgs: DataFrame) -> DataFrame:
    """Streaming O-F4 / O-E7: completed reports and list edits as they finish.

    Output rows carry ``kind`` ('report' | 'edit') and a JSON payload.  The
    turns take the same steps as in batch; the state of an author is the open
    session and is removed when none is open.
    """
    from ..session import ship_package
    ship_package(turns.sparkSession)
    key = ["author_id", "turn_seq"]
    first = DG.resolve_link(turns, guilds, chans, msgs)
    toks = DG.explode_links(turns, key)
    c = chans.select(F.col("guild_id").alias("_cg"), F.col("channel_id").alias("_c")).distinct()
    m = msgs.select(F.col("channel_id").alias("_mc"), F.col("message_id").alias("_m"))
    ok = (toks.join(c, (F.col("link.guild_id") == F.col("_cg")) & (F.col("link.channel_id") == F.col("_c")))
              .join(m, (F.col("link.channel_id") == F.col("_mc")) & (F.col("link.message_id") == F.col("_m"))))
    # ids as text: a nullable 64-bit column would pass through floats
    nothing = F.lit(None).cast("string")
    base = first.select(*key, "content", "link_reason", F.col("link_message_id").cast("string").alias("link_message_id"),
                        choice_number(F.col("content"), 7).cast("string").alias("choice"), F.lit(-1).alias("tok_no"), nothing.alias("extra_id"))
    rows = base.unionByName(ok.select(*key, nothing.alias("content"), nothing.alias("link_reason"), nothing.alias("link_message_id"),
                                      nothing.alias("choice"), "tok_no", F.col("_m").cast("string").alias("extra_id")))
    rows = rows.withColumn("turn_seq", F.col("turn_seq").cast("string"))

    def fn(k, pdfs, state):
        turns_by, extra = {}, {}
        for pdf in pdfs:
            for seq, content, reason, link, choice, tok, other in zip(*(pdf[c] for c in (
                    "turn_seq", "content", "link_reason", "link_message_id", "choice", "tok_no", "extra_id"))):
                if tok >= 0:
                    extra.setdefault(int(seq), []).append((int(tok), int(other)))
                else:
                    turns_by[int(seq)] = {
                        "author_id": int(k[0]), "turn_seq": int(seq), "content": content or "", "link_reason": reason or None,
                        "link_message_id": int(link) if link else None, "choice": int(choice) if choice else None}
        rows = [{**t, "extra_ids": [i for _, i in sorted(extra.get(s, []))]} for s, t in sorted(turns_by.items())]
        reports, edits, session = DG.fold_resume(rows, json.loads(state.get[0]) if state.exists else None)
        if session is None:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(session),))
        out = [("report", json.dumps(r)) for r in reports] + [("edit", json.dumps(dict(zip(DG.EDIT_COLS, e)))) for e in edits]
        yield pd.DataFrame(out, columns=["kind", "payload"])
    return rows.groupBy("author_id").applyInPandasWithState(
        fn, "kind string, payload string", "session string", "append", GroupStateTimeout.NoTimeout)
