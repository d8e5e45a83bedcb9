"""Prefix trie of conversations by ROLLUP over positional turn-id columns."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, Scratch, crc_of_id, partitions, read_table

BLOCK = 8                    # turn-id columns of one block
RUN = 1024                   # blocks of a conversation that are summed in one window
PIECE = 4096                 # conversation ids joined to one piece of text


def number_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv``, ``pos`` (from 1), ``tid``, ``words`` of every turn.

    Turns are dealt by ranges of (conversation, turn, role, text), counted
    per range, and numbered inside their range from there, so a conversation
    with most of the turns is spread over many tasks. ``tid`` is 128 bits of
    the SHA-256 of role and text.
    """
    spark = turns.sparkSession
    content = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = turns.withColumn("tid", F.unhex(F.substring(F.sha2(content, 256), 1, 32))).withColumn(
        "words", F.regexp_count("text", F.lit(WORD)).cast("long"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    # equal rows are interchangeable, so a random last key may part them
    ranges = rows.repartitionByRange(partitions(spark), *order, F.rand(11)).sortWithinPartitions(*order)
    # the order of a part needs no texts any more: the row's place in it stands for them
    ranges = ranges.select("conv", "tid", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    ranges = scratch.put(ranges, "ranges")
    counts = ranges.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv", "part").orderBy("place")
    return ranges.withColumn("row", F.row_number().over(inside)).join(counts, ["conv", "part"]).select(
        "conv", (F.col("before") + F.col("row")).alias("pos"), "tid", "words")


def share_openings(turns: DataFrame, group: int, most: int) -> DataFrame:
    """Conversations rebuilt from a shared opening: the first h turns of the
    group's first conversation (id - id % group), then the own turns after
    the first h; h = crc32(decimal id) % ``most``. One row per turn, and one
    with null ``pos`` for each conversation without turns.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"), F.max(F.struct("pos")).pos.alias("last"))
    convs = convs.select("conv", (crc_of_id(F.col("conv")) % most).alias("h"), "own", (F.col("conv") - F.col("conv") % group).alias("base"))
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    heads = turns.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "tid", "words")
    heads = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "tid", "words")
    tails = turns.join(convs.select("conv", "h", "taken"), "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "words")
    none = convs.where((F.col("taken") == 0) & (F.col("own") <= F.col("h"))).select(
        "conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"), F.lit(0).cast("long").alias("words"))
    return heads.union(tails).union(none)


def _mark(seed: int, pos: Column, tid: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos, tid)


def _xor(columns: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out.bitwiseXOR(c)
    return out


def cut_blocks(turns: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block of ``width`` turns: the turn ids
    ``t1..``, their words ``w1..`` and the node ``pa``, ``pb`` that the block
    hangs from.

    A node is named by two 64-bit sums (exclusive or) of the hashes of all
    (position, turn id) up to it, so a block knows the node before it from
    sums over the earlier blocks and needs no pass per block.
    """
    slot = F.pmod(F.col("pos") - 1, F.lit(width)) + 1
    cells = [F.max(F.when(slot == j, F.col("tid"))).alias(f"t{j}") for j in range(1, width + 1)]
    words = [F.coalesce(F.max(F.when(slot == j, F.col("words"))), F.lit(0)).alias(f"w{j}") for j in range(1, width + 1)]
    sums = [F.coalesce(F.bit_xor(F.when(F.col("pos").isNotNull(), _mark(s, F.col("pos"), F.col("tid")))), F.lit(0)).alias(f"x{s}") for s in (1, 2)]
    block = F.coalesce(F.floor((F.col("pos") - 1) / width), F.lit(0)).alias("block")
    blocks = turns.groupBy("conv", block).agg(F.max("pos").alias("end"), *cells, *words, *sums)
    blocks = blocks.withColumn("run", F.floor(F.col("block") / RUN))
    runs = blocks.groupBy("conv", "run").agg(F.bit_xor("x1").alias("r1"), F.bit_xor("x2").alias("r2"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", *[F.coalesce(F.bit_xor(f"r{s}").over(earlier), F.lit(0)).alias(f"r{s}") for s in (1, 2)])
    inside = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(runs, ["conv", "run"])
    for s, name in ((1, "pa"), (2, "pb")):
        blocks = blocks.withColumn(name, F.col(f"r{s}").bitwiseXOR(F.coalesce(F.bit_xor(f"x{s}").over(inside), F.lit(0))))
    return blocks.drop("run", "r1", "r2")


def roll_up(blocks: DataFrame, width: int, measures: str) -> DataFrame:
    """``measures`` of all prefixes of all blocks in one aggregation: ROLLUP
    over the turn-id columns, the level told by grouping_id. Columns:
    ``level``, ``depth``, node ``a``, ``b``, parent ``up_a``, ``up_b``."""
    cells = ", ".join(f"t{j}" for j in range(1, width + 1))
    out = blocks.sparkSession.sql(
        f"SELECT block, pa, pb, {cells}, grouping_id() AS gid, {measures} FROM {{blocks}} GROUP BY block, pa, pb, ROLLUP ({cells})", blocks=blocks)
    level = F.lit(width) - F.length(F.replace(F.bin("gid"), F.lit("0"), F.lit(""))).cast("int")
    out = out.withColumn("level", level)
    # a prefix as long as its level has a turn there; the empty one is the root or ends the block before
    last = F.when(F.col("level") == 0, F.col("block") == 0)
    for j in range(1, width + 1):
        last = last.when(F.col("level") == j, F.col(f"t{j}").isNotNull())
    out = out.where(last).withColumn("depth", F.col("block") * width + F.col("level"))

    def name(seed: int, prior: str, less: int) -> Column:
        marks = [F.when(F.col("level") - less >= j, _mark(seed, F.col("block") * width + j, F.col(f"t{j}"))).otherwise(F.lit(0)) for j in range(1, width + 1)]
        return F.col(prior).bitwiseXOR(_xor(marks))

    return out.select("*", name(1, "pa", 0).alias("a"), name(2, "pb", 0).alias("b"), name(1, "pa", 1).alias("up_a"), name(2, "pb", 1).alias("up_b")).drop(
        "block", "pa", "pb", "gid", *[f"t{j}" for j in range(1, width + 1)])


def hash_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined decimal ids (``conv``) of each
    node ``a``, ``b``. Ranges of ids are joined to pieces of at most
    ``PIECE`` ids in parallel; one task a node then hashes the pieces in
    order and holds one at a time."""
    spark = ends.sparkSession

    def join(batches):
        node, first, ids = None, None, []
        for batch in batches:
            out = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node != (a, b) or len(ids) == PIECE:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids = (a, b), conv, []
                ids.append(str(conv))
            yield rows(out)
        yield rows([(*node, first, ",".join(ids))] if ids else [])

    def rows(out):
        cols = list(zip(*out)) if out else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["a", "b", "first", "piece"])

    def digest(batches):
        node, h = None, None
        for batch in batches:
            out = []
            for a, b, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if node == (a, b):
                    h.update(b"," + piece.encode())
                    continue
                if node is not None:
                    out.append((*node, h.hexdigest()))
                node, h = (a, b), hashlib.sha256(piece.encode())
            yield done(out)
        yield done([(*node, h.hexdigest())] if node is not None else [])

    def done(out):
        cols = list(zip(*out)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["a", "b", "ends_sha256"])

    n = partitions(spark)
    order = ["a", "b", "conv"]
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join, "a long, b long, first long, piece string")
    pieces = pieces.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first")
    return pieces.mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, scratch: Scratch, width: int = BLOCK) -> DataFrame:
    """Nodes of the trie of turn sequences.

    ``turns`` has ``conv``, ``pos`` (dense from 1; null for a conversation
    without turns), ``tid`` and ``words``. Each distinct sequence of first d
    turn ids is a node; its members are the conversations that start with it.
    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``; an empty table gives no node.

    One ROLLUP over blocks of ``width`` turn-id columns gives members of all
    prefixes; longer conversations go on in further blocks keyed by the node
    before. Sums over subtrees are sums over members: along its turns a
    conversation is the smallest member from some depth on, so it counts the
    words of the nodes before that depth as saved (all members but the
    smallest save a node once), and a childless node is counted by its
    smallest member. A second ROLLUP adds these up. Turn sequences are told
    apart by 128-bit hashes.
    """
    blocks = scratch.put(cut_blocks(turns, width), "blocks")
    nodes = scratch.put(roll_up(blocks, width, "min(conv) AS conv_id, count(*) AS n_convs").drop("level"), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"])
    nodes = scratch.put(nodes, "counted")

    first = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("own_from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    rows = blocks.drop("x1", "x2").join(first, "conv", "left")
    at = [F.col("block") * width + j for j in range(1, width + 1)]
    shared = [F.when(F.coalesce(p < F.col("own_from"), F.lit(True)), F.col(f"w{j}")).otherwise(F.lit(0)) for j, p in enumerate(at, 1)]
    for j, s in enumerate(shared, 1):
        rows = rows.withColumn(f"s{j}", s)
    total = sum((F.col(f"s{j}") for j in range(2, width + 1)), F.col("s1"))
    rows = rows.withColumn("all", total).withColumn("run", F.floor(F.col("block") / RUN))
    runs = rows.groupBy("conv", "run").agg(F.sum("all").alias("r"))
    after = Window.partitionBy("conv").orderBy(F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", F.coalesce(F.sum("r").over(after), F.lit(0)).alias("r"))
    later = Window.partitionBy("conv", "run").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(runs, ["conv", "run"]).withColumn("later", F.col("r") + F.coalesce(F.sum("all").over(later), F.lit(0)))
    tail = F.col("later")
    for j in range(width, 0, -1):
        tail = tail + F.col(f"s{j}")
        rows = rows.withColumn(f"v{j}", tail)
    rows = rows.withColumn("v0", F.col("v1")).withColumn("leaf", F.coalesce("leaf", F.lit(0)))
    rows = rows.select("conv", "block", "pa", "pb", "leaf", *[f"t{j}" for j in range(1, width + 1)], *[f"v{j}" for j in range(width + 1)])
    measures = "sum(leaf) AS n_leaves, " + ", ".join(f"sum(v{j}) AS v{j}" for j in range(width + 1))
    sums = roll_up(scratch.put(rows, "shared"), width, measures)
    saved = F.element_at(F.array(*[F.col(f"v{j}") for j in range(width + 1)]), F.col("level") + 1)
    sums = sums.select("a", "b", "n_leaves", saved.alias("saved_tokens"))

    whole = blocks.groupBy("conv").agg(F.bit_xor("x1").alias("a"), F.bit_xor("x2").alias("b"))
    ends = hash_ends(whole)
    # from its first own node on a conversation is its own parent; only that first one looks its parent up
    nodes = nodes.join(first.select(F.col("conv").alias("conv_id"), "own_from"), "conv_id")
    branches = nodes.where("depth = own_from and depth > 0").select("a", "b", "up_a", "up_b").alias("n").join(
        nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent")), ["up_a", "up_b"]).select("a", "b", "parent")
    out = nodes.join(branches, ["a", "b"], "left").join(sums, ["a", "b"]).join(ends, ["a", "b"], "left")
    parent = F.when(F.col("depth") > F.col("own_from"), F.col("conv_id")).otherwise(F.col("parent"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      group: int = 20, most: int = 4, width: int = BLOCK) -> DataFrame:
    """``prefix_trie`` of conversations rebuilt by ``share_openings``.

    Turns are ordered by turn (null first; equal ones by role and text); null
    roles and texts count as empty. Words are ``[^\\x20\\x09-\\x0D]+``. Rows
    that repeat are turns of their own. Rows without a conversation id
    belong to no conversation. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "trie")
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    numbered = scratch.put(number_turns(turns, scratch), "turns")
    return prefix_trie(scratch.put(share_openings(numbered, group, most), "rebuilt"), scratch, width)


def op11_conversation_trie(spark, sf_dir):
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


SQL = r"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
crc_table AS (
  WITH RECURSIVE t AS (
    SELECT range::BIGINT AS b, range::BIGINT AS v, 0 AS k FROM range(256)
    UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM t WHERE k < 8)
  SELECT list(v ORDER BY b) AS tab FROM t WHERE k = 8),
k AS (
  SELECT c, c - c % 20 AS base, own,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda s, x: xor(s >> 8, tab[(xor(s, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS own FROM o GROUP BY c), crc_table),
r AS (
  SELECT k.c, o.p, o.role, o.text FROM k JOIN o ON o.c = k.base AND o.p <= k.h
  UNION ALL
  SELECT k.c, o.p - k.h + least(k.h, coalesce(b.own, 0)), o.role, o.text FROM k JOIN o ON o.c = k.c AND o.p > k.h LEFT JOIN k b ON b.c = k.base),
l AS (
  SELECT k.c, coalesce(list(length(r.role) || ':' || r.role || r.text ORDER BY r.p) FILTER (r.p IS NOT NULL), []) AS seq,
         coalesce(list(len(regexp_extract_all(r.text, '[^\x20\x09-\x0D]+')) ORDER BY r.p) FILTER (r.p IS NOT NULL), []) AS words
  FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
m AS (
  SELECT c, d, len(seq) AS n, md5(array_to_string(list_transform(seq[1:d], lambda x: md5(x)), '')) AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM (SELECT *, unnest(generate_series(0, len(seq))) AS d FROM l)),
v AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM m GROUP BY node, d),
e AS (SELECT DISTINCT a.node AS up, b.node AS node FROM m a JOIN m b ON a.c = b.c AND b.d = a.d + 1),
f AS (SELECT v.*, coalesce(x.n, 0) AS n_children FROM v LEFT JOIN (SELECT up, count(*) AS n FROM e GROUP BY up) x ON x.up = v.node),
s AS (SELECT DISTINCT a.node AS top, b.node AS node FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
g AS (
  SELECT s.top, sum((f.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.w)::BIGINT AS saved_tokens
  FROM s JOIN f ON f.node = s.node GROUP BY s.top)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, g.n_leaves, g.saved_tokens, f.ends_sha256
FROM f JOIN g ON g.top = f.node LEFT JOIN e ON e.node = f.node LEFT JOIN f u ON u.node = e.up
"""
