"""Moderation tables derived from the driver's tables.

messages  <- documents      (doc_id -> message_id, source -> channel)
accounts  <- customer       (c_name -> user, floor(c_acctbal) -> followers)
actions   <- events / orders (see strikes and actions queries)
dialogs   <- conversations  (user turns replayed as direct messages)

Every derivation is plain column arithmetic so the DuckDB oracle can state
the same tables in SQL (see ``oracle.py``).  All work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import REPORT_CATEGORIES

# The test term list and pattern list the queries match with.
TEST_TERMS = ["idiot", "moron", "scum", "trash", "clown", "worthless",
              "pathetic", "loser", "disgusting", "stupid"]
TEST_PATTERNS = ["[0-9]{16}", "[A-Za-z0-9.]+@mail[0-9]+"]
# Rules for street addresses stated in a message (JVM / RE2 common subset).
TEST_PII_RULES = [
    "[0-9]{1,5} [A-Z][a-z]+ (Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)",
    "[Ll]ives (on|at) [A-Za-z0-9 ]{1,40} (street|avenue|road|lane|drive)",
]
# Moderation group the bot belongs to; its monitored channel is group-7.
GROUP = 7
BOT_NAME = "Group 7 Bot"
BOT_ID = 0
LINK_BASE = "https://chat.example/channels/"
EPOCH = "2024-01-01 00:00:00"
# Fixed value: message ids start here (chat platforms use ids of this size).
ID_BASE = 2**60


_MEMO: dict = {}


def shared(fn):
    """Build a stand-in frame once per query construction.

    DataFrames are immutable, so helpers that need the same derived table
    reuse one object (and one plan subtree).  ``clear_shared`` runs at the
    start of every registered query, so each query still builds in full.
    """
    def wrapper(spark, sf_dir, *args):
        key = (fn.__module__, fn.__qualname__, id(spark), sf_dir, args)
        if key not in _MEMO:
            _MEMO[key] = fn(spark, sf_dir, *args)
        return _MEMO[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


def clear_shared() -> None:
    _MEMO.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all task slots when the scan yields fewer splits.

    A file written as one row group is read by one task however many splits
    it gets.  With at least as many splits as slots (any large input) the
    scan is returned unchanged, so no shuffle is added at scale.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots)


@shared
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel and direct messages (``guild_id`` null = direct message)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    src_no = F.substring("source", 4, 16).try_cast("bigint")
    guild = F.when(src_no != 0, F.col("doc_id") % 25)
    channel_id = F.coalesce(guild, F.lit(99)) * 100 + src_no
    name = (F.when(src_no == 18, F.lit(f"group-{GROUP}-human-mod"))
            .when(src_no == 19, F.lit(f"group-{GROUP}-mod"))
            .otherwise(F.concat(F.lit("group-"), src_no.cast("string"))))
    author = F.col("doc_id") % 500
    address = F.when(F.col("doc_id") % 17 == 0, F.concat(
        F.lit(" He lives at "), (F.col("doc_id") % 900 + 100).cast("string"),
        F.lit(" Maple Street."))).otherwise(F.lit(""))
    return d.select(
        (F.col("doc_id") + ID_BASE).alias("message_id"),
        guild.alias("guild_id"),
        channel_id.alias("channel_id"),
        name.alias("channel_name"),
        author.alias("author_id"),
        F.concat(F.lit("Customer#"), F.lpad(author.cast("string"), 9, "0")).alias("author_name"),
        F.concat(F.col("text"), address).alias("content"),
        F.timestamp_add("MINUTE", F.col("doc_id"),
                        F.lit(EPOCH).cast("timestamp_ntz")).alias("created_at"),
        F.concat(F.lit(LINK_BASE), F.coalesce(guild.cast("string"), F.lit("@me")), F.lit("/"),
                 channel_id.cast("string"), F.lit("/"),
                 (F.col("doc_id") + ID_BASE).cast("string")).alias("jump_url"),
    )


@shared
def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_name").alias("user_name"),
                    F.floor("c_acctbal").cast("bigint").alias("followers"))


# Lengths of the listed passages.
PASSAGE_LENGTHS = [6, 9, 12, 15, 20, 30, 40, 60, 90, 120, 200, 300]


@shared
def large_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long term list: passages of the documents, and one- and two-digit
    numbers from the customers."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lengths = F.array(*[F.lit(n) for n in PASSAGE_LENGTHS])
    start = (F.col("doc_id") * 31 + F.col("j") * 97) % F.greatest(F.length("text") - 20, F.lit(1)) + 1
    passages = d.select("doc_id", "text", F.posexplode(lengths).alias("j", "n")).select(
        F.substring("text", start.cast("int"), F.col("n")).alias("term"))
    key = table(spark, sf_dir, "customer").select("c_nationkey")
    numbers = key.select(F.explode(F.array((F.col("c_nationkey") % 10).cast("string"),
                                           (F.col("c_nationkey") + 10).cast("string"))).alias("term"))
    return passages.unionByName(numbers).distinct()


# ------------------------------------------------------------- scorers ----
# Stand-in for the remote scorers: replies are computed from the message id
# so both engines can state them; they include exact-threshold values,
# failed calls (null reply) and a reply missing one attribute.

# Fixed values: (attribute, multiplier, offset) of the synthetic scores.
ATTR_RULES = [("TOXICITY", 7, 0), ("SPAM", 13, 100), ("IDENTITY_ATTACK", 31, 200),
              ("INSULT", 37, 300), ("THREAT", 53, 400)]
# Synthetic chat replies, chosen by message_id % 6.
CHAT_TEXTS = ["Yes, the post is harassment.", "No.", "yes", " Yes", "No, it is not.", "Yes"]


def _score_text(idcol, mult: int, off: int):
    k = ((idcol % 1000) * mult + off) % 1000
    return F.concat(F.lit("0."), F.lpad(k.cast("string"), 3, "0"))


def attribute_reply(idcol):
    parts = [F.concat(F.lit(f'"{a}": {{"summaryScore": {{"value": '), _score_text(idcol, m, o),
                      F.lit("}}")) for a, m, o in ATTR_RULES]
    body = F.concat_ws(", ", *parts[:-1])
    threat = F.when(idcol % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(", "), parts[-1]))
    return F.when(idcol % 13 != 0, F.concat(F.lit('{"attributeScores": {'), body, threat, F.lit("}}")))


def chat_reply(idcol):
    text = F.element_at(F.array(*[F.lit(t) for t in CHAT_TEXTS]), (idcol % 6 + 1).cast("int"))
    return F.when(idcol % 19 != 0, F.concat(
        F.lit('{"choices": [{"message": {"content": "'), text, F.lit('"}}]}')))


def synthetic_scorer(df: DataFrame) -> DataFrame:
    """Scorer hook: adds ``attr_scores`` and ``chat_content`` from replies."""
    from ..functions.replies import parse_attribute_reply, parse_chat_reply
    return (df.withColumn("attr_scores", parse_attribute_reply(attribute_reply(F.col("message_id"))))
              .withColumn("chat_content", parse_chat_reply(chat_reply(F.col("message_id")))))


# ---------------------------------------------------------- evaluation ----
SEED = 42
NEGATIVE = "not_cyberbullying"


@shared
def labeled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``post,label`` lines: documents joined with their labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    label = F.when(F.col("toxic") == 1, F.lit("cyberbullying")).otherwise(F.lit(NEGATIVE))
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("post_id"),
        F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(","), label).alias("value"))


def order_key(id_col: str = "post_id"):
    """Seeded shuffle order both engines can compute (a 60-bit hash)."""
    from ..operators.evaluate import hash_key
    return hash_key(id_col, SEED)


# ------------------------------------------------------ actions, reports ----
# The moderator reaction set, and the stand-in choice of
# reaction per event ((event_id + user_id) % 9; the ninth is not in the set).
ACTION_EMOJIS = ["⏱️", "🛑", "🗑️", "❗", "‼️", "❌", "❔", "⬆️"]
OTHER_EMOJI = "👍"
# Flipped bits of the event id, so that moderators handle
# reports out of their order of creation.
ORDER_FLIP = 2048 + 21


@shared
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderator reactions: one per event, on the post of report (user, day)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    guild = F.col("user_id") % 25
    emoji = F.element_at(F.array(*[F.lit(x) for x in ACTION_EMOJIS + [OTHER_EMOJI]]),
                         ((F.col("event_id") + F.col("user_id")) % 9 + 1).cast("int"))
    return e.select(
        F.col("event_id").bitwiseXOR(F.lit(ORDER_FLIP)).alias("action_seq"),
        F.col("ts").alias("acted_at"),
        F.when(F.col("event_id") % 50 == 0, F.lit(BOT_ID).cast("bigint"))
         .otherwise(F.col("user_id") % 7 + 1).alias("actor_id"),
        guild.alias("guild_id"),
        F.when(F.col("event_id") % 23 == 0, guild * 100 + 3).otherwise(guild * 100 + 18).alias("channel_id"),
        # every 37th reaction lands on a post that is no report (+500 days)
        (F.col("user_id") * 1000 + F.dayofyear("ts")
         + F.when(F.col("event_id") % 37 == 0, F.lit(500)).otherwise(F.lit(0))).alias("post_id"),
        emoji.alias("emoji"))


@shared
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per (user, day) of the event log, posted under that id."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    a = e.select((F.col("user_id") * 1000 + F.dayofyear("ts")).alias("post_id")).distinct()
    user = (F.col("post_id") / 1000).cast("bigint")
    is_auto = user % 5 == 0
    return a.select(
        F.concat(F.lit("R"), F.col("post_id").cast("string")).alias("report_id"),
        "post_id",
        user.alias("abuser_id"),
        F.concat(F.lit("Customer#"), F.lpad(user.cast("string"), 9, "0")).alias("abuser_name"),
        F.when(~is_auto, (user * 7 + 3) % 150).alias("reporter_id"),
        is_auto.alias("is_auto"),
        F.timestamp_add("DAY", F.col("post_id") % 1000 - 1,
                        F.lit(EPOCH).cast("timestamp_ntz")).alias("report_created_at"),
        F.element_at(F.array(*[F.lit(REPORT_CATEGORIES[k]) for k in sorted(REPORT_CATEGORIES)]),
                     (F.col("post_id") % 6 + 1).cast("int")).alias("abuse_type"),
        F.concat(F.lit(LINK_BASE + "0/0/"), F.col("post_id").cast("string")).alias("jump_url"),
        F.concat(F.lit("reported message "), F.col("post_id").cast("string")).alias("content"))


@shared
def report_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posted report -> report id bridge (every report is posted)."""
    return reports(spark, sf_dir).select("post_id", "report_id")
BALANCE_AS_OF = "1999-06-30 00:00:00"


# ----------------------------------------------------------- list edits ----
# Items the stand-in edit log adds and removes.
WORD_VOCAB = TEST_TERMS + ["  Stupid ", "jerk", "MORON"]
REGEX_VOCAB = TEST_PATTERNS + ["[0-9]{9}", "[Ll]oser[0-9]+"]


@shared
def list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit log: one multi-line edit per event (kind by event type)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    word = F.col("event_type").isin("click", "view", "signup")

    def pick(vocab, shift):
        return F.element_at(F.array(*[F.lit(v) for v in vocab]),
                            ((F.col("user_id") + shift) % len(vocab) + 1).cast("int"))
    first = F.when(word, pick(WORD_VOCAB, 0)).otherwise(pick(REGEX_VOCAB, 0))
    second = F.when(F.col("event_id") % 4 == 0, F.concat(
        F.lit("\n"), F.when(word, pick(WORD_VOCAB, 3)).otherwise(pick(REGEX_VOCAB, 3)))).otherwise(F.lit(""))
    blank = F.when(word & (F.col("event_id") % 29 == 0), F.lit("\n  ")).otherwise(F.lit(""))
    trail = F.when(F.col("event_id") % 7 == 0, F.lit("\n")).otherwise(F.lit(""))
    return e.select(
        F.col("event_id").alias("edit_seq"), F.col("ts").alias("edited_at"),
        F.when(word, F.lit("word")).otherwise(F.lit("regex")).alias("list_kind"),
        F.when(F.col("event_id") % 3 == 0, F.lit("remove")).otherwise(F.lit("add")).alias("op"),
        F.concat(first, blank, second, trail).alias("content"))


# ------------------------------------------------------------ dm turns ----
# What the author of a thread types, by (author % 8), in order;
# afterwards 'list'.  <LINK> and <LINKS> become links to messages, <TEXT> the
# beginning of the conversation turn.
DM_SCRIPTS = [
    ["report", "<LINK>", "1", "3", "1", "skip", "1", "1", "blocklist", "2", "jerk"],
    ["report", "<LINK>", "5", "2", "<LINKS>", "2", "1", "blocklist", "5", "[0-9]{9}", "6"],
    ["report", "not a link", "<LINK>", "6", "<TEXT>", "<LINKS>", "1", "2", "help", "search x"],
    ["report me", "<LINK>", "2", "skip", "1", "1", "report", "<LINK>", "3", "<LINKS>", "2", "2"],
    ["blocklist", "3", " Moron ", "6", "[0-9]{9}", "9", "2", "one\ntwo", "cancel", "report", "<LINK>"],
    ["report", "<LINK>", "4", "<LINKS>", " 2 ", "2", "list", "strike", "search a b"],
    ["help", "report", "<LINK>", "9", "1", "7", "2", "<LINKS>", "1", "1"],
    ["report", "cancel", "report", "help", "<LINK>", "5", "9", "3", "skip", "2", "1"],
]


def _link(m):
    g = m % 25
    return F.concat(F.lit(LINK_BASE), g.cast("string"), F.lit("/"), (g * 100 + m % 20).cast("string"),
                    F.lit("/"), (m + ID_BASE).cast("string"))


@shared
def dm_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct-message threads: the user turns of four conversations are one
    author's thread, whose n-th turn is the n-th input of a script."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    author = F.floor(F.col("conv_id") / 4).cast("bigint")
    k = F.row_number().over(Window.partitionBy(author).orderBy("conv_id", "turn"))
    c = c.select(author.alias("author_id"), ((F.col("conv_id") % 4) * 10 + F.col("turn")).cast("bigint").alias("turn_seq"), "text", k.alias("k"))
    scripts = F.array(*[F.array(*[F.lit(x) for x in row]) for row in DM_SCRIPTS])
    typed = F.try_element_at(F.element_at(scripts, (F.col("author_id") % 8 + 1).cast("int")), F.col("k"))
    mid = F.col("author_id") * 40 + F.col("k")
    content = (F.when(typed == "<LINK>", _link(mid))
               .when(typed == "<LINKS>", F.concat(_link(mid + 1), F.lit(" "), _link(mid + 2), F.lit(" junk")))
               .when(typed == "<TEXT>", F.substring("text", 1, 40))
               .otherwise(F.coalesce(typed, F.lit("list"))))
    return c.select("author_id", "turn_seq", content.alias("content"),
                    F.concat(F.lit("Reporter#"), F.col("author_id").cast("string")).alias("author_name"))
