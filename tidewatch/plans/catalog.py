"""Registered queries: one per operator of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` reading the driver tables
(or moderation tables derived from them) in full, plus, where the operator
is relational, the DuckDB SQL that computes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import render as R
from ..functions.text import present, with_normalized
from ..operators import matching as M
from ..session import ship_package
from . import sqltext as Q
from . import standins as S

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def _widen(df: DataFrame) -> DataFrame:
    """Report every integral column as bigint (one integer type per engine)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark, sf_dir):
            ship_package(spark)
            S.clear_shared()
            return _widen(fn(spark, sf_dir))
        QUERIES[name] = run
        QUERIES[name].__name__ = fn.__name__
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@S.shared
def normalized_messages(spark, sf_dir) -> DataFrame:
    return with_normalized(S.messages(spark, sf_dir), "content")


# ------------------------------------------------------------- sources ----

@register("read_messages", Q.with_(Q.MESSAGES) + "SELECT * FROM messages")
def q_read_messages(spark, sf_dir):
    return S.messages(spark, sf_dir)


# ----------------------------------------------------- text + matching ----

@register("normalize_text", Q.with_(Q.MESSAGES, Q.NORM)
          + "SELECT message_id, stripped, folded, lowered FROM norm")
def q_normalize_text(spark, sf_dir):
    return normalized_messages(spark, sf_dir).select(
        "message_id", "stripped", "folded", "lowered")


@register("blocklist_match", Q.with_(Q.MESSAGES, Q.NORM, Q.TERM_HITS, Q.FIRST_TERM)
          + "SELECT message_id, term, hit_start, hit_end, CAST(1 AS DOUBLE) AS score "
            "FROM first_term")
def q_blocklist_match(spark, sf_dir):
    m = M.match_terms(normalized_messages(spark, sf_dir), S.TEST_TERMS)
    return (present(m, "term_hit")
            .select("message_id", F.col("h.item").alias("term"),
                    F.col("h.start").alias("hit_start"), F.col("h.end").alias("hit_end"),
                    F.lit(1.0).alias("score")))


@register("large_blocklist_match", Q.with_(Q.MESSAGES, Q.NORM, Q.LARGE_HITS, Q.FIRST_TERM)
          + "SELECT message_id, term, hit_start, hit_end FROM first_term")
def q_large_blocklist_match(spark, sf_dir):
    m = M.match_terms(normalized_messages(spark, sf_dir), S.large_terms(spark, sf_dir))
    return (present(m, "term_hit")
            .select("message_id", F.col("h.item").alias("term"),
                    F.col("h.start").alias("hit_start"), F.col("h.end").alias("hit_end")))


@register("indexed_blocklist_match", Q.with_(Q.MESSAGES, Q.NORM, Q.LARGE_HITS, Q.FIRST_TERM)
          + "SELECT message_id, term, hit_start, hit_end FROM first_term")
def q_indexed_blocklist_match(spark, sf_dir):
    m = M.match_indexed(normalized_messages(spark, sf_dir), M.load_terms(S.large_terms(spark, sf_dir)), "lowered", "term_hit")
    return (present(m, "term_hit")
            .select("message_id", F.col("h.item").alias("term"),
                    F.col("h.start").alias("hit_start"), F.col("h.end").alias("hit_end")))


@register("match_all_terms", Q.with_(Q.MESSAGES, Q.NORM, Q.TERM_HITS)
          + "SELECT message_id, term, hit_start, hit_end FROM term_hits")
def q_match_all_terms(spark, sf_dir):
    h = M.term_hits(normalized_messages(spark, sf_dir), S.TEST_TERMS)
    return h.select("message_id", "term", F.col("start").alias("hit_start"),
                    F.col("end").alias("hit_end"))


@register("highlight_hit", Q.with_(Q.MESSAGES, Q.NORM, Q.TERM_HITS, Q.FIRST_TERM)
          + f"SELECT f.message_id, {Q.lit(R.REASON_TERM)} || '`' || f.term || '` at \"' || "
          + Q.highlight("n.stripped", "f.hit_start", "f.hit_end")
          + " || '\"' AS reason FROM first_term f JOIN norm n USING (message_id)")
def q_highlight_hit(spark, sf_dir):
    m = M.match_terms(normalized_messages(spark, sf_dir), S.TEST_TERMS)
    return (present(m, "term_hit")
            .select("message_id", R.hit_reason(R.REASON_TERM, F.col("h"), F.col("stripped")).alias("reason")))


# ------------------------------------------------------------- scoring ----

from ..functions import replies as RP  # noqa: E402
from ..operators import decide as D  # noqa: E402
from ..operators import routing as RT  # noqa: E402

_ATTR_COLS = [("TOXICITY", "toxicity"), ("SPAM", "spam"), ("IDENTITY_ATTACK", "identity_attack"),
              ("INSULT", "insult"), ("THREAT", "threat")]


@S.shared
def scored_messages(spark, sf_dir) -> DataFrame:
    return S.synthetic_scorer(S.messages(spark, sf_dir).select("message_id"))


@register("parse_attribute_reply", Q.with_(Q.MESSAGES, Q.SCORES)
          + "SELECT message_id, " + ", ".join(f"{Q.SCORE_COLS[a]} AS {c}" for a, c in _ATTR_COLS)
          + " FROM scores")
def q_parse_attribute_reply(spark, sf_dir):
    s = scored_messages(spark, sf_dir)
    return s.select("message_id", *[F.try_element_at("attr_scores", F.lit(a)).alias(c)
                                    for a, c in _ATTR_COLS])


@register("score_attributes", Q.with_(Q.MESSAGES, Q.SCORES)
          + "SELECT message_id, attribute, score FROM scores UNPIVOT (score FOR attribute IN ("
          + ", ".join(f"{Q.SCORE_COLS[a]} AS '{a}'" for a, _ in _ATTR_COLS) + ")) WHERE score IS NOT NULL")
def q_score_attributes(spark, sf_dir):
    s = scored_messages(spark, sf_dir)
    return s.select("message_id", F.explode("attr_scores").alias("attribute", "score"))


@register("parse_chat_reply", Q.with_(Q.MESSAGES, Q.SCORES)
          + "SELECT message_id, chat_content FROM scores")
def q_parse_chat_reply(spark, sf_dir):
    return scored_messages(spark, sf_dir).select("message_id", "chat_content")


@register("verdict_prefix", Q.with_(Q.MESSAGES, Q.SCORES)
          + "SELECT message_id, coalesce(starts_with(chat_content, 'Yes'), false) AS harassment, "
            "coalesce(starts_with(chat_content, 'True'), false) AS address FROM scores")
def q_verdict_prefix(spark, sf_dir):
    s = scored_messages(spark, sf_dir)
    return s.select("message_id", RP.verdict_prefix("chat_content", RP.HARASSMENT_PREFIX).alias("harassment"),
                    RP.verdict_prefix("chat_content", RP.ADDRESS_PREFIX).alias("address"))


@register("threshold_first", Q.with_(Q.MESSAGES, Q.SCORES)
          + f"SELECT message_id, a IS NOT NULL AS flagged, a AS attribute FROM (SELECT message_id, "
          + Q.threshold_first_sql(Q.SCORE_COLS, RP.PRODUCTION_THRESHOLDS) + " AS a FROM scores) x")
def q_threshold_first(spark, sf_dir):
    s = scored_messages(spark, sf_dir).withColumn("a", RP.threshold_first("attr_scores"))
    return s.select("message_id", F.col("a").isNotNull().alias("flagged"), F.col("a").alias("attribute"))


@register("fail_open", Q.with_(Q.MESSAGES, Q.SCORES)
          + "SELECT message_id, attr_reply IS NULL AS attr_failed, chat_reply IS NULL AS chat_failed, "
          + Q.threshold_first_sql(Q.SCORE_COLS, RP.PRODUCTION_THRESHOLDS) + " AS attribute, "
            "coalesce(starts_with(chat_content, 'Yes'), false) AS chat_flag FROM scores "
            "WHERE attr_reply IS NULL OR chat_reply IS NULL")
def q_fail_open(spark, sf_dir):
    idc = F.col("message_id")
    s = (S.messages(spark, sf_dir).select("message_id")
         .where(S.attribute_reply(idc).isNull() | S.chat_reply(idc).isNull()))
    s = S.synthetic_scorer(s)
    return s.select("message_id", S.attribute_reply(idc).isNull().alias("attr_failed"),
                    S.chat_reply(idc).isNull().alias("chat_failed"),
                    RP.threshold_first("attr_scores").alias("attribute"),
                    RP.verdict_prefix("chat_content").alias("chat_flag"))


@register("ensemble_decide", Q.with_(Q.MESSAGES, Q.SCORES)
          + "SELECT message_id, CAST(CASE WHEN a IS NOT NULL AND h THEN 1 WHEN a IS NOT NULL OR h THEN 0.5 "
            "ELSE 0 END AS DOUBLE) AS score FROM (SELECT message_id, "
          + Q.threshold_first_sql(Q.SCORE_COLS, RP.PRODUCTION_THRESHOLDS) + " AS a, "
            "coalesce(starts_with(chat_content, 'Yes'), false) AS h FROM scores) x")
def q_ensemble_decide(spark, sf_dir):
    s = scored_messages(spark, sf_dir)
    e = D.ensemble(RP.threshold_first("attr_scores"), RP.verdict_prefix("chat_content"))
    return s.select("message_id", e["score"].alias("score"))


# ----------------------------------------------------- pattern + cascade ----

@register("regex_match", Q.with_(Q.MESSAGES, Q.NORM, Q.regex_hits_cte())
          + "SELECT message_id, pattern, hit_start, hit_end FROM first_regex")
def q_regex_match(spark, sf_dir):
    m = M.match_regexes(normalized_messages(spark, sf_dir), S.TEST_PATTERNS)
    return (present(m, "regex_hit")
            .select("message_id", F.col("h.item").alias("pattern"),
                    F.col("h.start").alias("hit_start"), F.col("h.end").alias("hit_end")))


@register("unmatched_messages", Q.with_(Q.MESSAGES, Q.NORM, Q.TERM_HITS, Q.regex_hits_cte())
          + "SELECT message_id FROM norm WHERE message_id NOT IN (SELECT message_id FROM term_hits) "
            "AND message_id NOT IN (SELECT message_id FROM regex_hits)")
def q_unmatched_messages(spark, sf_dir):
    return M.unmatched(normalized_messages(spark, sf_dir), S.TEST_TERMS, S.TEST_PATTERNS).select("message_id")


@register("pii_street_flag", Q.with_(Q.MESSAGES, Q.NORM)
          + f"SELECT message_id, {Q.pii_sql('folded')} AS pii FROM norm")
def q_pii_street_flag(spark, sf_dir):
    n = normalized_messages(spark, sf_dir)
    return n.select("message_id", D.pii_flag(F.col("folded"), S.TEST_PII_RULES).alias("pii"))


def _eval_sql(term_hits: str) -> str:
    return Q.with_(Q.MESSAGES, Q.NORM, term_hits, Q.FIRST_TERM, Q.regex_hits_cte(), Q.SCORES) + f""",
dec AS (
  SELECT n.message_id, n.content, n.author_id, n.jump_url, n.stripped, ft.term, ft.hit_start AS t_s, ft.hit_end AS t_e,
         fr.pattern, fr.hit_start AS r_s, fr.hit_end AS r_e, {Q.pii_sql('n.folded')} AS pii,
         {Q.threshold_first_sql(Q.SCORE_COLS, RP.PRODUCTION_THRESHOLDS)} AS a,
         coalesce(starts_with(s.chat_content, 'Yes'), false) AS h
  FROM norm n LEFT JOIN first_term ft USING (message_id) LEFT JOIN first_regex fr USING (message_id)
       JOIN scores s USING (message_id)
),
evaluated AS (
  SELECT message_id, content, author_id, jump_url,
    CAST(CASE WHEN term IS NOT NULL OR pattern IS NOT NULL OR pii THEN 1
              WHEN a IS NOT NULL AND h THEN 1 WHEN a IS NOT NULL OR h THEN 0.5 ELSE 0 END AS DOUBLE) AS score,
    CASE WHEN term IS NOT NULL THEN {Q.lit(R.REASON_TERM)} || '`' || term || '` at "' || {Q.highlight('stripped', 't_s', 't_e')} || '"'
         WHEN pattern IS NOT NULL THEN {Q.lit(R.REASON_REGEX)} || '`' || pattern || '` at "' || {Q.highlight('stripped', 'r_s', 'r_e')} || '"'
         WHEN pii THEN {Q.lit(R.REASON_PII)}
         WHEN a IS NOT NULL AND h THEN {Q.lit(R.REASON_BOTH)}
         WHEN h THEN {Q.lit(R.REASON_CHAT_ONLY)}
         WHEN a IS NOT NULL THEN {Q.lit(R.REASON_ATTR_ONLY)}
         ELSE {Q.lit(R.REASON_NONE)} END AS reason,
    CASE WHEN term IS NOT NULL THEN 'term' WHEN pattern IS NOT NULL THEN 'regex' WHEN pii THEN 'pii'
         WHEN a IS NOT NULL OR h THEN 'ensemble' ELSE 'none' END AS stage,
    CASE WHEN term IS NULL AND pattern IS NULL AND NOT pii THEN a END AS attribute,
    CASE WHEN term IS NULL AND pattern IS NULL AND NOT pii THEN h END AS chat_flag
  FROM dec
)
"""


_EVAL_SQL = _eval_sql(Q.TERM_HITS)


@S.shared
def evaluated_messages(spark, sf_dir) -> DataFrame:
    msgs = S.messages(spark, sf_dir).select("message_id", "author_id", "jump_url", "content")
    return D.evaluate(msgs, S.TEST_TERMS, S.TEST_PATTERNS, S.TEST_PII_RULES, scorer=S.synthetic_scorer)


@register("evaluate_messages", _EVAL_SQL
          + "SELECT message_id, score, reason, stage, attribute, chat_flag FROM evaluated")
def q_evaluate_messages(spark, sf_dir):
    return evaluated_messages(spark, sf_dir).select(
        "message_id", "score", "reason", "stage", "attribute", "chat_flag")


@register("evaluate_large_list", _eval_sql(Q.LARGE_HITS)
          + "SELECT message_id, score, reason, stage, attribute, chat_flag FROM evaluated")
def q_evaluate_large_list(spark, sf_dir):
    msgs = S.messages(spark, sf_dir).select("message_id", "content")
    dec = D.evaluate(msgs, S.large_terms(spark, sf_dir), S.TEST_PATTERNS, S.TEST_PII_RULES, scorer=S.synthetic_scorer)
    return dec.select("message_id", "score", "reason", "stage", "attribute", "chat_flag")


@register("enforce_deletions", _EVAL_SQL
          + "SELECT message_id, author_id AS recipient_id, 'Your message ' || jump_url || ' with text ' "
            "|| content || ' has been deleted for reason: ' || reason || '.' AS text FROM evaluated "
            "WHERE score = 1")
def q_enforce_deletions(spark, sf_dir):
    return D.deletions(evaluated_messages(spark, sf_dir))


@register("format_evaluation", _EVAL_SQL
          + "SELECT message_id, 'Evaluated: ''' || content || ''': ' || CASE WHEN score = 0.5 THEN '0.5' "
            "ELSE CAST(CAST(score AS BIGINT) AS VARCHAR) END || ', reason: ' || reason AS evaluation "
            "FROM evaluated")
def q_format_evaluation(spark, sf_dir):
    return D.format_evaluation(evaluated_messages(spark, sf_dir))


@register("auto_reports", _EVAL_SQL
          + f"SELECT substr(sha256('auto|' || CAST(message_id AS VARCHAR)), 1, 32) AS report_id, "
            f"'{D.AUTO_REPORTER}' AS reporter, true AS is_auto, message_id, '{D.AUTO_TYPE}' AS abuse_type, "
            f"CASE WHEN chat_flag THEN '{D.DETAIL_CHAT}' ELSE '{D.DETAIL_ATTR_PREFIX}' || attribute || "
            f"'{D.DETAIL_ATTR_SUFFIX}' END AS other_details FROM evaluated WHERE score = 0.5")
def q_auto_reports(spark, sf_dir):
    return D.auto_reports(evaluated_messages(spark, sf_dir))


# ------------------------------------------------------------- routing ----

@register("drop_own_messages", Q.with_(Q.MESSAGES)
          + f"SELECT message_id, author_id FROM messages WHERE author_id <> {S.BOT_ID}")
def q_drop_own_messages(spark, sf_dir):
    return RT.drop_own(S.messages(spark, sf_dir), S.BOT_ID).select("message_id", "author_id")


@register("split_dm", Q.with_(Q.MESSAGES)
          + "SELECT message_id, CASE WHEN guild_id IS NULL THEN 'dm' ELSE 'channel' END AS kind FROM messages")
def q_split_dm(spark, sf_dir):
    ch, dm = RT.split_dm(S.messages(spark, sf_dir))
    return (ch.select("message_id", F.lit("channel").alias("kind"))
            .unionByName(dm.select("message_id", F.lit("dm").alias("kind"))))


@register("monitored_channel", Q.with_(Q.MESSAGES)
          + f"SELECT message_id, channel_name FROM messages WHERE channel_name = 'group-{S.GROUP}'")
def q_monitored_channel(spark, sf_dir):
    return RT.monitored(S.messages(spark, sf_dir), S.GROUP).select("message_id", "channel_name")


@S.shared
def channels(spark, sf_dir) -> DataFrame:
    """Guild channels seen in the message table (position = channel id)."""
    return (S.messages(spark, sf_dir).where(F.col("guild_id").isNotNull())
            .select("guild_id", "channel_id", "channel_name",
                    F.col("channel_id").alias("position")).distinct())


_ROUTES_SQL = f"""
routes AS (
  SELECT guild_id,
         max(CASE WHEN channel_name = 'group-{S.GROUP}-human-mod' THEN channel_id END) AS human_mod_channel,
         max(CASE WHEN channel_name = 'group-{S.GROUP}-mod' THEN channel_id END) AS auto_mod_channel
  FROM messages WHERE guild_id IS NOT NULL AND channel_name IN ('group-{S.GROUP}-human-mod', 'group-{S.GROUP}-mod')
  GROUP BY guild_id
)"""


@register("build_routes", Q.with_(Q.MESSAGES, _ROUTES_SQL) + "SELECT * FROM routes")
def q_build_routes(spark, sf_dir):
    return RT.build_routes(channels(spark, sf_dir), S.BOT_NAME)


@register("route_messages", Q.with_(Q.MESSAGES, _ROUTES_SQL)
          + "SELECT m.message_id, m.guild_id, r.human_mod_channel, r.auto_mod_channel "
            "FROM messages m LEFT JOIN routes r USING (guild_id) WHERE m.guild_id IS NOT NULL")
def q_route_messages(spark, sf_dir):
    ch, _ = RT.split_dm(S.messages(spark, sf_dir))
    routes = RT.build_routes(channels(spark, sf_dir), S.BOT_NAME)
    return RT.route(ch, routes).select("message_id", "guild_id", "human_mod_channel", "auto_mod_channel")


# ---------------------------------------------------------- evaluation ----

from ..operators import evaluate as EV  # noqa: E402

_VARIANT_SETS = {"low": RP.EVAL_THRESHOLDS_LOW, "high": RP.EVAL_THRESHOLDS_HIGH,
                 "production": RP.PRODUCTION_THRESHOLDS}


@S.shared
def labeled_posts(spark, sf_dir) -> DataFrame:
    return EV.parse_labeled_lines(S.labeled_lines(spark, sf_dir), "value", S.NEGATIVE).select(
        "post_id", "post", "label", "is_positive")


@S.shared
def scored_posts(spark, sf_dir) -> DataFrame:
    """Labelled posts with scorer results; failed calls dropped (O-H7)."""
    p = labeled_posts(spark, sf_dir).select("post_id", "is_positive")
    idc = F.col("post_id")
    p = (p.withColumn("attr_reply", S.attribute_reply(idc))
          .withColumn("chat_reply", S.chat_reply(idc)))
    p = EV.drop_failed(p, ["attr_reply", "chat_reply"])
    return (p.withColumn("attr_scores", RP.parse_attribute_reply("attr_reply"))
             .withColumn("chat_content", RP.parse_chat_reply("chat_reply"))
             .withColumn("attr_pred", RP.any_over("attr_scores", RP.EVAL_THRESHOLDS_HIGH))
             .withColumn("chat_pred", RP.verdict_prefix("chat_content")))


_POST_SCORES = (Q.LINES + "," + Q.scores_cte("pscores", "posts", "post_id") + f""",
kept AS (
  SELECT p.post_id, p.is_positive, {Q.order_key_sql('p.post_id')} AS k,
         ({Q.threshold_first_sql(Q.SCORE_COLS, RP.EVAL_THRESHOLDS_HIGH)}) IS NOT NULL AS attr_pred,
         coalesce(starts_with(s.chat_content, 'Yes'), false) AS chat_pred,
         {', '.join(f"({Q.threshold_first_sql(Q.SCORE_COLS, v)}) IS NOT NULL AS v_{n}" for n, v in _VARIANT_SETS.items())}
  FROM posts p JOIN pscores s USING (post_id)
  WHERE s.attr_reply IS NOT NULL AND s.chat_reply IS NOT NULL
),
pairs AS (
  SELECT p.pair_idx, p.post_id AS pos_id, n.post_id AS neg_id, p.attr_pred AS pa, p.chat_pred AS pc,
         n.attr_pred AS na, n.chat_pred AS nc
  FROM (SELECT *, row_number() OVER (ORDER BY k, post_id) AS pair_idx FROM kept WHERE is_positive) p
  JOIN (SELECT *, row_number() OVER (ORDER BY k, post_id) AS pair_idx FROM kept WHERE NOT is_positive) n
    USING (pair_idx)
),
pair_preds AS (
  SELECT pair_idx, 0 AS variant, pa AND pc AS pos_pred, na AND nc AS neg_pred FROM pairs UNION ALL
  SELECT pair_idx, 1, pa, na FROM pairs UNION ALL
  SELECT pair_idx, 2, pc, nc FROM pairs UNION ALL
  SELECT pair_idx, 3, pa OR pc, na OR nc FROM pairs
)""")


@register("read_labeled_posts", Q.with_(Q.LINES) + "SELECT post_id, post, label, is_positive FROM posts")
def q_read_labeled_posts(spark, sf_dir):
    return labeled_posts(spark, sf_dir)


@register("drop_failed", Q.with_(_POST_SCORES) + "SELECT post_id, is_positive FROM kept")
def q_drop_failed(spark, sf_dir):
    return scored_posts(spark, sf_dir).select("post_id", "is_positive")


@S.shared
def _pairs(spark, sf_dir):
    sp = scored_posts(spark, sf_dir)
    pairs = EV.balanced_pairs(sp, None, S.order_key("post_id"))
    return sp, pairs


@register("balanced_pairs", Q.with_(_POST_SCORES) + "SELECT pair_idx, pos_id, neg_id FROM pairs")
def q_balanced_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)[1].select("pair_idx", "pos_id", "neg_id")


@register("random_sample", Q.with_(_POST_SCORES)
          + "SELECT post_id, is_positive FROM kept ORDER BY k, post_id LIMIT 1000")
def q_random_sample(spark, sf_dir):
    sp = scored_posts(spark, sf_dir)
    return EV.random_sample(sp, 1000, S.order_key("post_id")).select("post_id", "is_positive")


@register("threshold_variants", Q.with_(_POST_SCORES)
          + "SELECT post_id, variant, pred FROM kept UNPIVOT (pred FOR variant IN ("
          + ", ".join(f"v_{n} AS '{n}'" for n in _VARIANT_SETS) + "))")
def q_threshold_variants(spark, sf_dir):
    return EV.threshold_variants(scored_posts(spark, sf_dir), "attr_scores", _VARIANT_SETS)


@register("ensemble_variants", Q.with_(_POST_SCORES)
          + "SELECT post_id, 0 AS variant, attr_pred AND chat_pred AS pred FROM kept UNION ALL "
            "SELECT post_id, 1, attr_pred FROM kept UNION ALL SELECT post_id, 2, chat_pred FROM kept "
            "UNION ALL SELECT post_id, 3, attr_pred OR chat_pred FROM kept")
def q_ensemble_variants(spark, sf_dir):
    return EV.ensemble_variants(scored_posts(spark, sf_dir), keep=["post_id"])


@S.shared
def pair_predictions(spark, sf_dir) -> DataFrame:
    sp = scored_posts(spark, sf_dir)
    j = EV.balanced_pairs(sp, None, S.order_key("post_id"), carry=["attr_pred", "chat_pred"])
    pa, pc, na, nc = (F.col(c) for c in ("pos_attr_pred", "pos_chat_pred", "neg_attr_pred", "neg_chat_pred"))
    arr = F.array(
        F.struct(F.lit(0).alias("variant"), (pa & pc).alias("pos_pred"), (na & nc).alias("neg_pred")),
        F.struct(F.lit(1).alias("variant"), pa.alias("pos_pred"), na.alias("neg_pred")),
        F.struct(F.lit(2).alias("variant"), pc.alias("pos_pred"), nc.alias("neg_pred")),
        F.struct(F.lit(3).alias("variant"), (pa | pc).alias("pos_pred"), (na | nc).alias("neg_pred")))
    return j.select("pair_idx", F.inline(arr))


@register("confusion_matrix", Q.with_(_POST_SCORES)
          + "SELECT variant, CAST(count_if(pos_pred) AS BIGINT) AS tp, CAST(count_if(neg_pred) AS BIGINT) AS fp, "
            "CAST(count_if(NOT neg_pred) AS BIGINT) AS tn, CAST(count_if(NOT pos_pred) AS BIGINT) AS fn "
            "FROM pair_preds GROUP BY variant")
def q_confusion_matrix(spark, sf_dir):
    pp = pair_predictions(spark, sf_dir)
    long = pp.select("variant", F.inline(F.array(
        F.struct(F.col("pos_pred").alias("pred"), F.lit(True).alias("is_positive")),
        F.struct(F.col("neg_pred").alias("pred"), F.lit(False).alias("is_positive")))))
    return EV.confusion(long, ["variant"])


@register("running_confusion", Q.with_(_POST_SCORES)
          + """SELECT * FROM (
  SELECT variant, pair_idx,
    CAST(sum(CAST(pos_pred AS INT)) OVER w AS BIGINT) AS tp,
    CAST(sum(CAST(NOT neg_pred AS INT)) OVER w AS BIGINT) AS tn,
    CAST(sum(CAST(neg_pred AS INT)) OVER w AS BIGINT) AS fp,
    CAST(sum(CAST(NOT pos_pred AS INT)) OVER w AS BIGINT) AS fn
  FROM pair_preds
  WINDOW w AS (PARTITION BY variant ORDER BY pair_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) x WHERE (tp + tn + fp + fn) % 50 = 0""")
def q_running_confusion(spark, sf_dir):
    return EV.running_confusion(pair_predictions(spark, sf_dir), 50)


@register("sample_confusion", Q.with_(_POST_SCORES)
          + f"""SELECT 'low' AS variant, CAST(count_if(v_low AND is_positive) AS BIGINT) AS tp,
  CAST(count_if(v_low AND NOT is_positive) AS BIGINT) AS fp,
  CAST(count_if(NOT v_low AND NOT is_positive) AS BIGINT) AS tn,
  CAST(count_if(NOT v_low AND is_positive) AS BIGINT) AS fn
FROM kept""")
def q_sample_confusion(spark, sf_dir):
    preds = scored_posts(spark, sf_dir).select("is_positive", F.lit("low").alias("variant"),
                          RP.any_over("attr_scores", RP.EVAL_THRESHOLDS_LOW).alias("pred"))
    return EV.confusion(preds, ["variant"])


# ------------------------------------------------- scorer on the texts ----

from ..operators import scorer as SC  # noqa: E402

# Cut-offs of the word scorer that are measured.
MODEL_CUTOFFS = [0.3, 0.5, 0.7]


@S.shared
def word_weights(spark, sf_dir) -> DataFrame:
    return SC.fit_word_weights(labeled_posts(spark, sf_dir), "post", "is_positive")


@register("fit_word_weights", Q.with_(Q.LINES, Q.WORD_WEIGHTS) + "SELECT word, weight FROM weights")
def q_fit_word_weights(spark, sf_dir):
    return word_weights(spark, sf_dir)


@register("score_texts", Q.with_(Q.MESSAGES, Q.LINES, Q.WORD_WEIGHTS, Q.text_scores_cte("scored", "messages", "message_id", "content"))
          + "SELECT message_id, score FROM scored")
def q_score_texts(spark, sf_dir):
    return SC.score_texts(S.messages(spark, sf_dir), word_weights(spark, sf_dir), "message_id", "content")


@register("model_confusion", Q.with_(Q.LINES, Q.WORD_WEIGHTS, Q.text_scores_cte("scored", "posts", "post_id", "post"))
          + f"""SELECT variant, CAST(count_if(score > variant AND is_positive) AS BIGINT) AS tp,
  CAST(count_if(score > variant AND NOT is_positive) AS BIGINT) AS fp,
  CAST(count_if(NOT score > variant AND NOT is_positive) AS BIGINT) AS tn,
  CAST(count_if(NOT score > variant AND is_positive) AS BIGINT) AS fn
FROM scored JOIN posts USING (post_id), (SELECT unnest({MODEL_CUTOFFS})::DOUBLE AS variant) v GROUP BY variant""")
def q_model_confusion(spark, sf_dir):
    posts = labeled_posts(spark, sf_dir)
    scored = SC.score_texts(posts, word_weights(spark, sf_dir), "post_id", "post").join(posts.select("post_id", "is_positive"), "post_id")
    cutoffs = F.array(*[F.struct(F.lit(c).alias("variant"), (F.col("score") > F.lit(c)).alias("pred")) for c in MODEL_CUTOFFS])
    return EV.confusion(scored.select("is_positive", F.inline(cutoffs)), ["variant"])


@register("evaluate_with_model", Q.with_(Q.MESSAGES, Q.NORM, Q.TERM_HITS, Q.FIRST_TERM, Q.regex_hits_cte(), Q.LINES, Q.WORD_WEIGHTS,
                                         Q.text_scores_cte("scored", "messages", "message_id", "content"))
          + f"""SELECT n.message_id, CAST(CASE WHEN t.term IS NOT NULL OR r.pattern IS NOT NULL OR {Q.pii_sql('n.folded')} THEN 1
    WHEN s.score > {dict(RP.PRODUCTION_THRESHOLDS)[SC.MODEL_ATTRIBUTE]} THEN 0.5 ELSE 0 END AS DOUBLE) AS score
FROM norm n LEFT JOIN first_term t USING (message_id) LEFT JOIN first_regex r USING (message_id) JOIN scored s USING (message_id)""")
def q_evaluate_with_model(spark, sf_dir):
    msgs = S.messages(spark, sf_dir).select("message_id", "content")
    scorer = SC.word_scorer(word_weights(spark, sf_dir))
    return D.evaluate(msgs, S.TEST_TERMS, S.TEST_PATTERNS, S.TEST_PII_RULES, scorer=scorer).select("message_id", "score")


# ----------------------------------------------------- actions, strikes ----

from ..operators import actions as AC  # noqa: E402
from ..operators import strikes as ST  # noqa: E402


@S.shared
def action_context(spark, sf_dir) -> DataFrame:
    routes = RT.build_routes(channels(spark, sf_dir), S.BOT_NAME)
    posts = S.report_posts(spark, sf_dir)
    valid = AC.valid_actions(S.actions(spark, sf_dir), routes, posts, S.BOT_ID)
    corr = AC.correlate(valid, posts, S.reports(spark, sf_dir))
    return AC.with_strikes(corr)


_ACT_SQL = Q.with_(Q.MESSAGES, _ROUTES_SQL, Q.ACTIONS).replace("WITH", "WITH RECURSIVE", 1) + f""",
valid AS (
  SELECT a.* FROM actions a JOIN routes r ON a.guild_id = r.guild_id AND a.channel_id = r.human_mod_channel
  WHERE a.post_id IN (SELECT post_id FROM report_posts)
    AND a.emoji IN ({', '.join(Q.lit(x) for x in AC.ACTION_SET)}) AND a.actor_id <> {S.BOT_ID}
),
corr AS (
  SELECT v.*, r.report_id, r.abuser_id, r.abuser_name, r.reporter_id, r.is_auto, r.report_created_at,
         r.abuse_type, r.jump_url, r.content
  FROM valid v JOIN report_posts p USING (post_id) JOIN reports r ON r.report_id = p.report_id
),
abuse_src AS (SELECT * FROM corr WHERE emoji IN ('❗', '‼️')),
false_src AS (SELECT * FROM corr WHERE emoji = '❔' AND NOT is_auto),
{Q.strikes_replay_ctes("abuse", "abuse_src", "abuser_id", "report_created_at", "action_seq", 365)},
{Q.strikes_replay_ctes("falses", "false_src", "reporter_id", "report_created_at", "action_seq", 30)},
struck AS (
  SELECT c.*, a.n_strikes AS n_abuse, f.n_strikes AS n_false
  FROM corr c LEFT JOIN abuse a ON a.seq = c.action_seq LEFT JOIN falses f ON f.seq = c.action_seq
)
"""


@register("valid_actions", _ACT_SQL + "SELECT action_seq, post_id, emoji FROM valid")
def q_valid_actions(spark, sf_dir):
    routes = RT.build_routes(channels(spark, sf_dir), S.BOT_NAME)
    v = AC.valid_actions(S.actions(spark, sf_dir), routes, S.report_posts(spark, sf_dir), S.BOT_ID)
    return v.select("action_seq", "post_id", "emoji")


@register("correlate_actions", _ACT_SQL
          + "SELECT action_seq, report_id, abuser_id, reporter_id, is_auto FROM corr")
def q_correlate_actions(spark, sf_dir):
    return action_context(spark, sf_dir).select("action_seq", "report_id", "abuser_id",
                                                "reporter_id", "is_auto")


@register("report_status", _ACT_SQL + """SELECT report_id,
  bool_or(emoji = '⏱️') AS slow_mode, bool_or(emoji = '🛑') AS blocked, bool_or(emoji = '🗑️') AS deleted,
  bool_or(emoji = '❌' OR coalesce(n_abuse >= 3, false)) AS banned, bool_or(emoji = '⬆️') AS escalation,
  bool_or(emoji IN ('❗', '‼️')) AS strike,
  bool_or(emoji = '❔' AND coalesce(n_false < 3, false)) AS false_report_strike
FROM struck GROUP BY report_id""")
def q_report_status(spark, sf_dir):
    return AC.report_status(action_context(spark, sf_dir))


@register("action_strikes", _ACT_SQL
          + "SELECT action_seq, abuser_id, n_abuse AS n_strikes FROM struck WHERE n_abuse IS NOT NULL")
def q_action_strikes(spark, sf_dir):
    s = action_context(spark, sf_dir).where(F.col("n_abuse").isNotNull())
    return s.select("action_seq", "abuser_id", F.col("n_abuse").alias("n_strikes"))


@register("false_report_strikes", _ACT_SQL
          + "SELECT action_seq, reporter_id, n_false AS n_strikes, CASE WHEN n_false < 3 THEN 'struck' "
            "ELSE 'restricted' END AS outcome FROM struck WHERE n_false IS NOT NULL")
def q_false_report_strikes(spark, sf_dir):
    s = action_context(spark, sf_dir).where(F.col("n_false").isNotNull())
    return s.select("action_seq", "reporter_id", F.col("n_false").alias("n_strikes"),
                    ST.false_report_ladder(F.col("n_false")).alias("outcome"))


@register("strike_ladder", _ACT_SQL
          + "SELECT action_seq, CASE WHEN n_abuse = 2 AND emoji = '‼️' THEN 'slowed' WHEN n_abuse < 3 "
            "THEN 'warned' ELSE 'banned' END AS outcome FROM struck WHERE n_abuse IS NOT NULL")
def q_strike_ladder(spark, sf_dir):
    s = action_context(spark, sf_dir).where(F.col("n_abuse").isNotNull())
    return s.select("action_seq", ST.abuse_ladder(F.col("n_abuse"), F.col("emoji")).alias("outcome"))


def _notif_sql() -> str:
    def t(text, **m):
        import re
        out, pos = [], 0
        for mm in re.finditer(r"\{(\w+)\}", text):
            if mm.start() > pos:
                out.append(Q.lit(text[pos:mm.start()]))
            out.append(f"CAST({m[mm.group(1)]} AS VARCHAR)")
            pos = mm.end()
        if pos < len(text):
            out.append(Q.lit(text[pos:]))
        return "(" + " || ".join(out) + ")"
    c = dict(url="jump_url", content="content", type="abuse_type", id="report_id",
             n="coalesce(n_abuse, n_false)")
    strike = "emoji IN ('❗', '‼️')"
    abuser = f"""CASE WHEN emoji = '⏱️' THEN {t(R.NOTICE_SLOW_ABUSER, **c)}
      WHEN emoji = '🗑️' THEN {t(R.NOTICE_DELETED_ABUSER, **c)}
      WHEN emoji = '❌' THEN {t(R.NOTICE_BANNED_ABUSER, **c)}
      WHEN {strike} AND n_abuse = 2 AND emoji = '‼️' THEN {t(R.NOTICE_STRIKE_SLOWED, **c)}
      WHEN {strike} AND n_abuse < 3 AND emoji <> '‼️' THEN {t(R.NOTICE_STRIKE_WARNED, **c)}
      WHEN {strike} AND n_abuse < 3 THEN {t(R.NOTICE_STRIKE_WARNED_LARGE, **c)}
      WHEN {strike} THEN {t(R.NOTICE_STRIKE_BANNED, **c)} END"""
    reporter = f"""CASE WHEN is_auto THEN NULL
      WHEN emoji = '⏱️' THEN {t(R.NOTICE_REPORTER_SLOW, **c)}
      WHEN emoji = '🛑' THEN {t(R.NOTICE_REPORTER_BLOCK, **c)}
      WHEN emoji = '🗑️' THEN {t(R.NOTICE_REPORTER_DELETED, **c)}
      WHEN emoji = '❌' THEN {t(R.NOTICE_REPORTER_BANNED, **c)}
      WHEN emoji = '⬆️' THEN {t(R.NOTICE_REPORTER_ESCALATED, **c)}
      WHEN emoji = '❔' THEN CASE WHEN n_false < 3 THEN {t(R.NOTICE_FALSE_STRUCK, **c)} ELSE {t(R.NOTICE_FALSE_RESTRICTED, **c)} END
      WHEN {strike} AND n_abuse = 2 AND emoji = '‼️' THEN {t(R.NOTICE_REPORTER_SLOWED, **c)}
      WHEN {strike} AND n_abuse < 3 THEN {t(R.NOTICE_REPORTER_STRUCK, **c)}
      WHEN {strike} THEN {t(R.NOTICE_REPORTER_BANNED, **c)} END"""
    return (_ACT_SQL + f"""SELECT * FROM (
  SELECT action_seq, 'abuser' AS recipient_role, abuser_id AS recipient_id, {abuser} AS text FROM struck
  UNION ALL
  SELECT action_seq, 'reporter', reporter_id, {reporter} FROM struck) x WHERE text IS NOT NULL""")


@register("action_notifications", _notif_sql())
def q_action_notifications(spark, sf_dir):
    return AC.notifications(action_context(spark, sf_dir))


# Strikes over the order history: customer = abuser, order date = report
# creation time, order key = action order (365-day horizon).

@register("abuse_strikes", Q.strikes_window_sql("orders", "o_custkey", "o_orderdate", "o_orderkey", 365,
                                                "o_orderkey, o_custkey"))
def q_abuse_strikes(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ST.strikes_window(o, "o_custkey", "o_orderdate", "o_orderkey", 365).select(
        "o_orderkey", "o_custkey", "n_strikes")


_REPLAY_SQL = ("WITH RECURSIVE " + Q.strikes_replay_ctes("s", "orders", "o_custkey", "o_orderdate", "o_orderkey", 365)
               + " SELECT seq AS o_orderkey, k AS o_custkey, n_strikes FROM s")


@register("abuse_strikes_replay", _REPLAY_SQL)
def q_abuse_strikes_replay(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ST.strikes_replay(o, "o_custkey", "o_orderdate", "o_orderkey", 365).select(
        "o_orderkey", "o_custkey", "n_strikes")


@register("strike_balance", f"""SELECT c.c_custkey,
  CAST(count_if(o.o_orderdate IS NOT NULL AND epoch_us(TIMESTAMP '{S.BALANCE_AS_OF}') - epoch_us(o.o_orderdate)
       < {365 * ST.DAY_US}) AS BIGINT) AS abuse_strikes
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def q_strike_balance(spark, sf_dir):
    users = S.table(spark, sf_dir, "customer").select("c_custkey")
    o = S.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    return ST.strike_balance(users, o.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey",
                             "o_orderdate", F.lit(S.BALANCE_AS_OF).cast("timestamp_ntz"), 365,
                             "abuse_strikes")


# ---------------------------------------------------------- list edits ----

from ..operators import lists as L  # noqa: E402


@register("split_edit_lines", Q.with_(Q.list_edits_cte())
          + "SELECT edit_seq, line_no, list_kind, op, item, valid FROM lines")
def q_split_edit_lines(spark, sf_dir):
    return L.edit_lines(S.list_edits(spark, sf_dir)).select(
        "edit_seq", "line_no", "list_kind", "op", "item", "valid")


@register("apply_edits", Q.with_(Q.list_edits_cte())
          + "SELECT edit_seq, line_no, list_kind, item, status FROM statuses")
def q_apply_edits(spark, sf_dir):
    return L.apply_edits(S.list_edits(spark, sf_dir), S.TEST_TERMS, check_patterns=True).select(
        "edit_seq", "line_no", "list_kind", "item", "status")


@register("current_list", Q.with_(Q.list_edits_cte()) + "SELECT list_kind, item FROM current_items")
def q_current_list(spark, sf_dir):
    return L.current_list(S.list_edits(spark, sf_dir), S.TEST_TERMS, check_patterns=True)


@register("render_list", Q.with_(Q.list_edits_cte()) + f"""SELECT k.list_kind,
  CASE WHEN k.list_kind = 'word' THEN {Q.lit(L.WORDS_HEADER)} ELSE {Q.lit(L.REGEX_HEADER)} END ||
  CASE WHEN c.items IS NULL OR len(c.items) = 0 THEN
       CASE WHEN k.list_kind = 'word' THEN {Q.lit(L.WORDS_EMPTY)} ELSE {Q.lit(L.REGEX_EMPTY)} END
       ELSE array_to_string(c.items, ',' || chr(10)) END AS view
FROM (VALUES ('word'), ('regex')) k(list_kind)
LEFT JOIN (SELECT list_kind, list_sort(list(item)) AS items FROM current_items GROUP BY list_kind) c
  USING (list_kind)""")
def q_render_list(spark, sf_dir):
    return L.render_list(L.current_list(S.list_edits(spark, sf_dir), S.TEST_TERMS))


@register("list_as_of", Q.with_(Q.MESSAGES, Q.NORM, Q.list_edits_cte()) + """,
eff AS (SELECT * FROM statuses WHERE list_kind = 'word' AND status IN ('added', 'removed')),
vers AS (
  SELECT item AS term, edited_at AS valid_from, valid_to FROM (
    SELECT *, lead(edited_at) OVER (PARTITION BY list_kind, item ORDER BY edit_seq, line_no) AS valid_to
    FROM eff) x WHERE status = 'added'
)
SELECT DISTINCT n.message_id, v.term FROM norm n JOIN vers v ON instr(n.lowered, v.term) > 0
WHERE (v.valid_from IS NULL OR n.created_at >= v.valid_from)
  AND (v.valid_to IS NULL OR n.created_at < v.valid_to)""")
def q_list_as_of(spark, sf_dir):
    msgs = normalized_messages(spark, sf_dir).select("message_id", "created_at", "lowered")
    return L.list_as_of(msgs, L.list_changes(S.list_edits(spark, sf_dir), S.TEST_TERMS))


# --------------------------------------------------- dialogs and reports ----

from ..functions.codes import REPORT_CATEGORIES  # noqa: E402
from ..functions.text import decode_choice, parse_message_link  # noqa: E402
from ..operators import dialog as DG  # noqa: E402
from ..operators import reports as RE  # noqa: E402

_LINK_RE = r"/([0-9]+)/([0-9]+)/([0-9]+)"


def _dm_sql() -> str:
    def link(m):
        return (f"'{S.LINK_BASE}' || CAST(({m}) % 25 AS VARCHAR) || '/' || "
                f"CAST((({m}) % 25) * 100 + ({m}) % 20 AS VARCHAR) || '/' || CAST({m} + {S.ID_BASE} AS VARCHAR)")
    scripts = "[" + ", ".join("[" + ", ".join(Q.lit(x) for x in row) + "]" for row in S.DM_SCRIPTS) + "]"
    mid = "author_id * 40 + k"
    return f"""
dm AS (
  SELECT author_id, turn_seq, 'Reporter#' || CAST(author_id AS VARCHAR) AS author_name,
         CASE WHEN typed = '<LINK>' THEN {link(mid)}
              WHEN typed = '<LINKS>' THEN {link(mid + ' + 1')} || ' ' || {link(mid + ' + 2')} || ' junk'
              WHEN typed = '<TEXT>' THEN substr(text, 1, 40) ELSE coalesce(typed, 'list') END AS content
  FROM (SELECT *, ({scripts})[author_id % 8 + 1][k] AS typed
        FROM (SELECT conv_id // 4 AS author_id, (conv_id % 4) * 10 + turn AS turn_seq, text,
                     row_number() OVER (PARTITION BY conv_id // 4 ORDER BY conv_id, turn) AS k
              FROM conversations WHERE role = 'user') a) b
)"""


@S.shared
def dm_world(spark, sf_dir):
    msgs = S.messages(spark, sf_dir)
    chans = channels(spark, sf_dir)
    guilds = chans.select("guild_id").distinct()
    return S.dm_turns(spark, sf_dir), guilds, chans, msgs


@register("classify_command")
def q_classify_command(spark, sf_dir):
    turns, guilds, chans, msgs = dm_world(spark, sf_dir)
    flagged = DG.session_flags(DG.prepare_turns(turns, guilds, chans, msgs))
    return RT.classify_command(flagged).select("author_id", "turn_seq", "command")


@register("parse_message_link", Q.with_(_dm_sql()) + f"""SELECT author_id, turn_seq,
  regexp_matches(content, '{_LINK_RE}') AS matched,
  CASE WHEN regexp_matches(content, '{_LINK_RE}') THEN TRY_CAST(regexp_extract(content, '{_LINK_RE}', 1) AS BIGINT) END AS guild_id,
  CASE WHEN regexp_matches(content, '{_LINK_RE}') THEN TRY_CAST(regexp_extract(content, '{_LINK_RE}', 2) AS BIGINT) END AS channel_id,
  CASE WHEN regexp_matches(content, '{_LINK_RE}') THEN TRY_CAST(regexp_extract(content, '{_LINK_RE}', 3) AS BIGINT) END AS message_id
FROM dm""")
def q_parse_message_link(spark, sf_dir):
    t = S.dm_turns(spark, sf_dir)
    return t.select("author_id", "turn_seq", parse_message_link(F.col("content")).alias("l")).select(
        "author_id", "turn_seq", "l.matched", "l.guild_id", "l.channel_id", "l.message_id")


_TOKENS_SQL = f""",
toks0 AS (SELECT author_id, turn_seq, string_split_regex({Q.strip('content')}, '\\s+') AS toks FROM dm),
toks AS (SELECT author_id, turn_seq, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS tok_no FROM toks0),
links AS (
  SELECT author_id, turn_seq, tok_no,
         TRY_CAST(regexp_extract(tok, '{_LINK_RE}', 1) AS BIGINT) AS g,
         TRY_CAST(regexp_extract(tok, '{_LINK_RE}', 2) AS BIGINT) AS c,
         TRY_CAST(regexp_extract(tok, '{_LINK_RE}', 3) AS BIGINT) AS m
  FROM toks WHERE regexp_matches(tok, '{_LINK_RE}')
)"""


@register("explode_links", Q.with_(_dm_sql()) + _TOKENS_SQL
          + " SELECT author_id, turn_seq, tok_no, g AS guild_id, c AS channel_id, m AS message_id FROM links")
def q_explode_links(spark, sf_dir):
    x = DG.explode_links(S.dm_turns(spark, sf_dir), ["author_id", "turn_seq"])
    return x.select("author_id", "turn_seq", "tok_no", "link.guild_id", "link.channel_id", "link.message_id")


_WORLD_SQL = """,
chans AS (SELECT DISTINCT guild_id, channel_id FROM messages WHERE guild_id IS NOT NULL),
guilds AS (SELECT DISTINCT guild_id FROM chans)"""


@register("resolve_link", Q.with_(Q.MESSAGES, _dm_sql()) + _WORLD_SQL + f""",
p AS (
  SELECT author_id, turn_seq, regexp_matches(content, '{_LINK_RE}') AS ok,
         TRY_CAST(regexp_extract(content, '{_LINK_RE}', 1) AS BIGINT) AS g,
         TRY_CAST(regexp_extract(content, '{_LINK_RE}', 2) AS BIGINT) AS c,
         TRY_CAST(regexp_extract(content, '{_LINK_RE}', 3) AS BIGINT) AS m
  FROM dm
)
SELECT p.author_id, p.turn_seq,
  CASE WHEN NOT p.ok THEN '{DG.LINK_UNREADABLE}' WHEN gg.guild_id IS NULL THEN '{DG.LINK_GUILD_UNKNOWN}'
       WHEN cc.channel_id IS NULL THEN '{DG.LINK_CHANNEL_UNKNOWN}'
       WHEN mm.message_id IS NULL THEN '{DG.LINK_MESSAGE_UNKNOWN}' END AS link_reason,
  CASE WHEN p.ok AND gg.guild_id IS NOT NULL AND cc.channel_id IS NOT NULL AND mm.message_id IS NOT NULL
       THEN p.m END AS link_message_id
FROM p LEFT JOIN guilds gg ON gg.guild_id = p.g
LEFT JOIN chans cc ON cc.guild_id = p.g AND cc.channel_id = p.c
LEFT JOIN messages mm ON mm.channel_id = p.c AND mm.message_id = p.m""")
def q_resolve_link(spark, sf_dir):
    turns, guilds, chans, msgs = dm_world(spark, sf_dir)
    return DG.resolve_link(turns, guilds, chans, msgs).select(
        "author_id", "turn_seq", "link_reason", "link_message_id")


@register("resolve_links_multi", Q.with_(Q.MESSAGES, _dm_sql()) + _TOKENS_SQL + _WORLD_SQL + """
SELECT l.author_id, l.turn_seq, array_to_string(list(l.m ORDER BY l.tok_no), ',') AS extra_ids
FROM links l JOIN chans cc ON cc.guild_id = l.g AND cc.channel_id = l.c
JOIN messages mm ON mm.channel_id = l.c AND mm.message_id = l.m
GROUP BY l.author_id, l.turn_seq""")
def q_resolve_links_multi(spark, sf_dir):
    turns, guilds, chans, msgs = dm_world(spark, sf_dir)
    r = DG.resolve_links(turns, ["author_id", "turn_seq"], chans, msgs)
    return r.select("author_id", "turn_seq", F.array_join("extra_ids", ",").alias("extra_ids"))


@register("decode_choice", Q.with_(_dm_sql()) + f"""SELECT author_id, turn_seq,
  CASE WHEN regexp_matches({Q.strip('content')}, '^[0-9]+$') AND TRY_CAST({Q.strip('content')} AS INTEGER) BETWEEN 1 AND 6
       THEN ([{', '.join(Q.lit(REPORT_CATEGORIES[k]) for k in sorted(REPORT_CATEGORIES))}])[TRY_CAST({Q.strip('content')} AS INTEGER)]
  END AS category FROM dm""")
def q_decode_choice(spark, sf_dir):
    t = S.dm_turns(spark, sf_dir)
    return t.select("author_id", "turn_seq", decode_choice(F.col("content"), REPORT_CATEGORIES).alias("category"))


@S.shared
def completed_reports(spark, sf_dir) -> DataFrame:
    turns, guilds, chans, msgs = dm_world(spark, sf_dir)
    done = DG.reports_from_turns(DG.prepare_turns(turns, guilds, chans, msgs))
    reporter = F.concat(F.lit("Reporter#"), F.col("author_id").cast("string"))
    return RE.new_reports(done, reporter).withColumn("report_created_at", F.timestamp_add(
        "MINUTE", F.col("end_seq"), F.lit(S.EPOCH).cast("timestamp_ntz")))


@S.shared
def full_reports(spark, sf_dir) -> DataFrame:
    ex = RE.attach_messages(RE.expand_related(completed_reports(spark, sf_dir)), S.messages(spark, sf_dir))
    return RE.account_size(RE.block_sets(ex), S.accounts(spark, sf_dir))


@S.shared
def dialog_status(spark, sf_dir) -> DataFrame:
    """Status of the dialog reports: one moderator reaction each."""
    seq = F.col("reporter_id") * 10000 + F.col("report_seq") * 10 + F.col("position")
    emoji = F.element_at(F.array(*[F.lit(x) for x in AC.ACTION_SET]), (seq % 8 + 1).cast("int"))
    acted = full_reports(spark, sf_dir).select(
        "report_id", "reporter_id", "is_auto", "report_created_at", seq.alias("action_seq"), emoji.alias("emoji"),
        F.substring("author_name", 10, 20).try_cast("bigint").alias("abuser_id"))
    return AC.report_status(AC.with_strikes(acted))


@register("replay_report_dialog")
def q_replay_report_dialog(spark, sf_dir):
    turns, guilds, chans, msgs = dm_world(spark, sf_dir)
    r = DG.reports_from_turns(DG.prepare_turns(turns, guilds, chans, msgs))
    return r.withColumn("other_message_ids", F.array_join("other_message_ids", ","))


@register("replay_list_dialog")
def q_replay_list_dialog(spark, sf_dir):
    turns, guilds, chans, msgs = dm_world(spark, sf_dir)
    return DG.list_edits_from_turns(DG.prepare_turns(turns, guilds, chans, msgs))


@register("new_report")
def q_new_report(spark, sf_dir):
    return completed_reports(spark, sf_dir).select("report_id", "reporter_id", "message_id", "abuse_type",
                                                   "safety_mode", "is_auto")


@register("expand_related")
def q_expand_related(spark, sf_dir):
    ex = RE.expand_related(completed_reports(spark, sf_dir))
    return ex.select("report_id", "parent_id", "message_id", "abuse_type", "harassment_type",
                     "imminent_danger", "other_details", "safety_mode", "block_requested")


@register("block_sets")
def q_block_sets(spark, sf_dir):
    b = RE.block_sets(RE.attach_messages(RE.expand_related(completed_reports(spark, sf_dir)), S.messages(spark, sf_dir)))
    return b.select("report_id", F.array_join("block_user", ",").alias("block_user"))


@register("account_size", Q.with_(Q.ACTIONS) + f"""SELECT r.report_id,
  coalesce(CAST(floor(c.c_acctbal) AS BIGINT), {RE.DEFAULT_FOLLOWERS}) AS followers,
  coalesce(CAST(floor(c.c_acctbal) AS BIGINT), {RE.DEFAULT_FOLLOWERS}) > {RE.LARGE_ACCOUNT_FOLLOWERS} AS large_account,
  CASE WHEN coalesce(CAST(floor(c.c_acctbal) AS BIGINT), {RE.DEFAULT_FOLLOWERS}) > {RE.LARGE_ACCOUNT_FOLLOWERS}
       THEN '{RE.STRIKE_LARGE}' ELSE '{RE.STRIKE_SMALL}' END AS strike_emoji
FROM reports r LEFT JOIN customer c ON c.c_name = r.abuser_name""")
def q_account_size(spark, sf_dir):
    a = RE.account_size(S.reports(spark, sf_dir), S.accounts(spark, sf_dir), "abuser_name")
    return a.select("report_id", "followers", "large_account", "strike_emoji")


@register("format_report")
def q_format_report(spark, sf_dir):
    return RE.format_report(full_reports(spark, sf_dir))


def _auto_report_sql() -> str:
    emoji = (f"CASE WHEN coalesce(CAST(floor(c.c_acctbal) AS BIGINT), {RE.DEFAULT_FOLLOWERS}) > {RE.LARGE_ACCOUNT_FOLLOWERS} "
             f"THEN '{RE.STRIKE_LARGE}' ELSE '{RE.STRIKE_SMALL}' END")
    lines = [
        "'Report ' || substr(sha256('auto|' || CAST(e.message_id AS VARCHAR)), 1, 32) || ' at time ' || strftime(m.created_at, '%Y-%m-%d %H:%M:%S') || ':'",
        "chr(9) || 'Reported message:'",
        "chr(9) || m.author_name || ': \"' || m.content || '\"'",
        "chr(9) || 'Link:' || m.jump_url",
        f"chr(9) || 'Reporter: {D.AUTO_REPORTER}'",
        f"chr(9) || 'Abuse Type: {D.AUTO_TYPE}'",
        f"chr(9) || chr(9) || 'Abuse Type Details: ' || CASE WHEN e.chat_flag THEN '{D.DETAIL_CHAT}' ELSE '{D.DETAIL_ATTR_PREFIX}' || e.attribute || '{D.DETAIL_ATTR_SUFFIX}' END",
        "chr(9) || 'Has reporter turned on safety mode: False'",
        "chr(9) || 'Has reporter blocked message sender: False'",
        "'Press ⏱️ to place abuser under slow mode.'",
        "'Press 🗑️ to delete the message.'",
        f"'Press ' || {emoji} || ' to send strike and warning to abuser.'",
        "'Press ❌ to ban abuser.'",
        "'Press ⬆️ to escalate to a specialized team that handles organized harassment'",
    ]
    text = " || chr(10) || ".join(lines)
    return _EVAL_SQL + f"""SELECT substr(sha256('auto|' || CAST(e.message_id AS VARCHAR)), 1, 32) AS report_id, {text} AS report_text
FROM evaluated e JOIN messages m USING (message_id) LEFT JOIN customer c ON c.c_name = m.author_name WHERE e.score = 0.5"""


@register("format_auto_report", _auto_report_sql())
def q_format_auto_report(spark, sf_dir):
    auto = RE.auto_report_rows(D.auto_reports(evaluated_messages(spark, sf_dir)), S.messages(spark, sf_dir))
    return RE.format_report(RE.account_size(auto, S.accounts(spark, sf_dir)))


@register("acknowledge_report", Q.with_(Q.ACTIONS) + f"""SELECT report_id,
  {Q.lit('Thank you for reporting ')} || abuse_type || '. Your report has been filed as report ' || report_id
  || {Q.lit('.' + chr(10) + 'We will notify you when your report has been reviewed and appropriate actions has been taken.' + chr(10))}
  || CASE WHEN abuse_type = 'Harassment' THEN {Q.lit(RE.ACK_HARASSMENT)}
          WHEN abuse_type = 'Imminent Danger' THEN {Q.lit(RE.ACK_DANGER)} ELSE {Q.lit(RE.ACK_OTHER)} END AS ack_text
FROM reports""")
def q_acknowledge_report(spark, sf_dir):
    return RE.acknowledge(S.reports(spark, sf_dir))


@register("post_report")
def q_post_report(spark, sf_dir):
    return RE.report_posts(full_reports(spark, sf_dir))


@register("list_my_reports")
def q_list_my_reports(spark, sf_dir):
    req = S.dm_turns(spark, sf_dir).select("author_id").distinct()
    lst = RE.list_my_reports(req, full_reports(spark, sf_dir))
    return lst.select("author_id", "report_id", "report_seq", "position")


@register("search_report")
def q_search_report(spark, sf_dir):
    reps = full_reports(spark, sf_dir)
    q = F.concat(F.lit("search "), F.col("report_id"))
    variants = F.array(  # own id, someone else's id, malformed id, missing id
        F.struct(F.col("reporter_id").alias("author_id"), q.alias("content")),
        F.struct((F.col("reporter_id") + 1).alias("author_id"), q.alias("content")),
        F.struct(F.col("reporter_id").alias("author_id"), F.lit("search not-an-id").alias("content")),
        F.struct(F.col("reporter_id").alias("author_id"), F.lit("search").alias("content")))
    req = reps.select(F.inline(variants))
    return RE.search_reports(req, reps, dialog_status(spark, sf_dir)).select("author_id", "content", "reply")


@register("load_terms", Q.with_(Q.list_edits_cte())
          + f"SELECT DISTINCT lower({Q.strip('raw')}) AS term FROM lines "
            f"WHERE list_kind = 'word' AND length({Q.strip('raw')}) > 0")
def q_load_terms(spark, sf_dir):
    """O-A5 on user-typed lists: every word line ever entered, cleaned."""
    lines = L.edit_lines(S.list_edits(spark, sf_dir)).where(F.col("list_kind") == "word")
    return M.load_terms(lines, "raw")


# ------------------------------------------------- dialog fold as SQL oracle ----
# The state machine of operators/dialog.py, walked per author by a recursive
# CTE over the resolved turns (DuckDB), one step per turn.

def _dialog_fold_sql() -> str:
    return Q.with_(Q.MESSAGES, _dm_sql()) + _TOKENS_SQL + _WORLD_SQL + f""",
p AS (
  SELECT author_id, turn_seq, content, regexp_matches(content, '{_LINK_RE}') AS ok,
         TRY_CAST(regexp_extract(content, '{_LINK_RE}', 1) AS BIGINT) AS g,
         TRY_CAST(regexp_extract(content, '{_LINK_RE}', 2) AS BIGINT) AS c,
         TRY_CAST(regexp_extract(content, '{_LINK_RE}', 3) AS BIGINT) AS m
  FROM dm
),
first_link AS (
  SELECT p.author_id, p.turn_seq,
         CASE WHEN p.ok AND gg.guild_id IS NOT NULL AND cc.channel_id IS NOT NULL AND mm.message_id IS NOT NULL
              THEN p.m END AS link_msg
  FROM p LEFT JOIN guilds gg ON gg.guild_id = p.g
  LEFT JOIN chans cc ON cc.guild_id = p.g AND cc.channel_id = p.c
  LEFT JOIN messages mm ON mm.channel_id = p.c AND mm.message_id = p.m
),
extra AS (
  SELECT l.author_id, l.turn_seq, array_to_string(list(l.m ORDER BY l.tok_no), ',') AS extras
  FROM links l JOIN chans cc ON cc.guild_id = l.g AND cc.channel_id = l.c
  JOIN messages mm ON mm.channel_id = l.c AND mm.message_id = l.m
  GROUP BY l.author_id, l.turn_seq
),
turns AS (
  SELECT d.author_id, d.turn_seq, d.content, f.link_msg, coalesce(e.extras, '') AS extras,
         CASE WHEN regexp_matches({Q.strip('d.content')}, '^[0-9]+$')
                   AND TRY_CAST({Q.strip('d.content')} AS INTEGER) BETWEEN 1 AND 7
              THEN TRY_CAST({Q.strip('d.content')} AS INTEGER) END AS ch,
         row_number() OVER (PARTITION BY d.author_id ORDER BY d.turn_seq) AS rn
  FROM dm d JOIN first_link f USING (author_id, turn_seq) LEFT JOIN extra e USING (author_id, turn_seq)
),
RECURSIVE_PLACEHOLDER"""


def _dialog_steps_sql() -> str:
    from ..functions.codes import HARASSMENT_CATEGORIES as HC, IMMINENT_DANGER_CATEGORIES as IC
    cats = lambda d: "[" + ", ".join(Q.lit(d[k]) for k in sorted(d)) + "]"
    ev = """CASE WHEN t.content = 'help' THEN 'noop'
      WHEN r.mode IS NULL AND starts_with(t.content, 'report') THEN 'open_report'
      WHEN r.mode IS NULL AND starts_with(t.content, 'blocklist') THEN 'open_list'
      WHEN r.mode IS NULL THEN 'noop'
      WHEN t.content = 'cancel' THEN 'cancel'
      WHEN r.mode = 'list' AND r.state = 'AWAITING_COMMAND' AND t.ch IN (2, 3, 5, 6) THEN 'list_menu'
      WHEN r.mode = 'list' AND r.state = 'AWAITING_COMMAND' THEN 'noop'
      WHEN r.mode = 'list' THEN 'list_payload'
      WHEN r.state = 'AWAITING_MESSAGE' AND t.link_msg IS NOT NULL THEN 'identified'
      WHEN r.state = 'MESSAGE_IDENTIFIED' AND t.ch BETWEEN 1 AND 6 THEN 'type'
      WHEN r.state = 'OTHER_DETAILS' THEN 'details'
      WHEN r.state = 'HARASSMENT_TYPE' AND t.ch BETWEEN 1 AND 7 THEN 'htype'
      WHEN r.state = 'MULTIPLE_HARASSER' AND t.ch BETWEEN 1 AND 7 THEN 'multi'
      WHEN r.state = 'IMMINENT_DANGER' AND t.ch BETWEEN 1 AND 3 THEN 'danger'
      WHEN r.state = 'ADD_MESSAGES' THEN 'extras'
      WHEN r.state = 'SAFETY_MODE' AND t.ch BETWEEN 1 AND 2 THEN 'safety'
      WHEN r.state = 'BLOCK_AWAITED' AND t.ch BETWEEN 1 AND 2 THEN 'block'
      ELSE 'noop' END"""
    return f"""steps(author_id, rn, turn_seq, mode, state, msg, atype, htype, multi, danger, details, extras,
      safety, block, start_seq, done, edit_kind, edit_op, edit_content) AS (
  SELECT DISTINCT author_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
         CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN),
         CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN),
         CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT), false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
         CAST(NULL AS VARCHAR)
  FROM turns
  UNION ALL
  SELECT author_id, rn, turn_seq,
    CASE ev WHEN 'open_report' THEN 'report' WHEN 'open_list' THEN 'list' WHEN 'cancel' THEN NULL
            WHEN 'block' THEN NULL ELSE mode END,
    CASE ev WHEN 'open_report' THEN 'AWAITING_MESSAGE' WHEN 'open_list' THEN 'AWAITING_COMMAND'
            WHEN 'cancel' THEN NULL WHEN 'list_menu' THEN 'L' || CAST(ch AS VARCHAR)
            WHEN 'list_payload' THEN 'AWAITING_COMMAND' WHEN 'identified' THEN 'MESSAGE_IDENTIFIED'
            WHEN 'type' THEN CASE ch WHEN 1 THEN 'HARASSMENT_TYPE' WHEN 5 THEN 'IMMINENT_DANGER'
                                     WHEN 6 THEN 'OTHER_DETAILS' ELSE 'ADD_MESSAGES' END
            WHEN 'details' THEN 'ADD_MESSAGES' WHEN 'htype' THEN 'MULTIPLE_HARASSER'
            WHEN 'multi' THEN 'ADD_MESSAGES' WHEN 'danger' THEN 'ADD_MESSAGES'
            WHEN 'extras' THEN 'SAFETY_MODE' WHEN 'safety' THEN 'BLOCK_AWAITED'
            WHEN 'block' THEN NULL ELSE state END,
    CASE WHEN ev = 'identified' THEN link_msg ELSE msg END,
    CASE WHEN ev = 'identified' THEN NULL WHEN ev = 'type' THEN ({cats(REPORT_CATEGORIES)})[ch] ELSE atype END,
    CASE WHEN ev = 'identified' THEN NULL WHEN ev = 'htype' THEN ({cats(HC)})[ch] ELSE htype END,
    CASE WHEN ev = 'identified' THEN NULL WHEN ev = 'multi' THEN ch = 1 ELSE multi END,
    CASE WHEN ev = 'identified' THEN NULL WHEN ev = 'danger' THEN ({cats(IC)})[ch] ELSE danger END,
    CASE WHEN ev = 'identified' THEN NULL WHEN ev = 'details' THEN content ELSE details END,
    CASE WHEN ev = 'identified' THEN '' WHEN ev = 'extras' THEN t_extras ELSE extras END,
    CASE WHEN ev = 'identified' THEN false WHEN ev = 'safety' THEN ch = 1 ELSE safety END,
    CASE WHEN ev = 'identified' THEN false WHEN ev = 'block' THEN ch = 1 ELSE block END,
    CASE WHEN ev = 'identified' THEN turn_seq ELSE start_seq END,
    ev = 'block',
    CASE WHEN ev = 'list_payload' AND content <> '' THEN CASE WHEN state IN ('L2', 'L3') THEN 'word' ELSE 'regex' END END,
    CASE WHEN ev = 'list_payload' AND content <> '' THEN CASE WHEN state IN ('L2', 'L5') THEN 'add' ELSE 'remove' END END,
    CASE WHEN ev = 'list_payload' AND content <> '' THEN content END
  FROM (
    SELECT r.author_id, t.rn, t.turn_seq, r.mode, r.state, r.msg, r.atype, r.htype, r.multi, r.danger,
           r.details, r.extras, r.safety, r.block, r.start_seq, t.content, t.ch, t.link_msg,
           t.extras AS t_extras, {ev} AS ev
    FROM steps r JOIN turns t ON t.author_id = r.author_id AND t.rn = r.rn + 1
  ) x
)
"""


def _dialog_sql(final: str) -> str:
    head = _dialog_fold_sql().replace("RECURSIVE_PLACEHOLDER", _dialog_steps_sql())
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + final


_REPLAY_REPORTS_SQL = _dialog_sql("""SELECT author_id, start_seq, turn_seq AS end_seq, msg AS message_id,
  atype AS abuse_type, htype AS harassment_type, multi AS multiple_harassers, danger AS imminent_danger,
  details AS other_details, extras AS other_message_ids, safety AS safety_mode, block AS block_requested
FROM steps WHERE done""")

_REPLAY_EDITS_SQL = _dialog_sql("""SELECT author_id, turn_seq, edit_kind AS list_kind, edit_op AS op,
  edit_content AS content FROM steps WHERE edit_kind IS NOT NULL""")


ORACLE["replay_report_dialog"] = _REPLAY_REPORTS_SQL
ORACLE["classify_command"] = _dialog_sql("""SELECT t.author_id, t.turn_seq,
  CASE WHEN t.content = 'help' THEN 'help' WHEN s.mode = 'report' THEN 'report_session'
       WHEN s.mode = 'list' THEN 'list_session'
       WHEN starts_with(t.content, 'report') THEN 'report'
       WHEN starts_with(t.content, 'blocklist') THEN 'blocklist' WHEN starts_with(t.content, 'list') THEN 'list'
       WHEN starts_with(t.content, 'strike') THEN 'strike' WHEN starts_with(t.content, 'search') THEN 'search'
       ELSE 'ignore' END AS command
FROM turns t JOIN steps s ON s.author_id = t.author_id AND s.rn = t.rn - 1""")
ORACLE["replay_list_dialog"] = _REPLAY_EDITS_SQL


def _uuid_sql(*parts: str) -> str:
    h = "sha256(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


_FULL_REPORTS_CTE = f""",
parents AS (
  SELECT {_uuid_sql('author_id', 'start_seq')} AS report_id, CAST(NULL AS VARCHAR) AS parent_id,
         author_id AS reporter_id, turn_seq AS report_seq, 0 AS position, msg AS message_id, atype AS abuse_type,
         htype AS harassment_type, multi AS multiple_harassers, danger AS imminent_danger,
         details AS other_details, safety AS safety_mode, block AS block_requested, extras
  FROM steps WHERE done
),
kid_ids AS (
  SELECT *, unnest(string_split(extras, ',')) AS kid, generate_subscripts(string_split(extras, ','), 1) - 1 AS pos
  FROM parents WHERE extras <> ''
),
kids AS (
  SELECT {_uuid_sql('report_id', 'pos')} AS report_id, report_id AS parent_id, reporter_id, report_seq, pos + 1 AS position,
         CAST(kid AS BIGINT) AS message_id, abuse_type, harassment_type, multiple_harassers, imminent_danger,
         other_details, safety_mode, block_requested, '' AS extras
  FROM kid_ids
),
allrep AS (SELECT * FROM parents UNION ALL SELECT * FROM kids),
blocked AS (
  SELECT a.report_id, m.author_name AS name FROM allrep a JOIN messages m ON m.message_id = a.message_id
  WHERE a.block_requested
  UNION ALL
  SELECT k.parent_id, m.author_name FROM kids k JOIN messages m ON m.message_id = k.message_id
  WHERE k.block_requested
)
"""

ORACLE["new_report"] = _dialog_sql(_FULL_REPORTS_CTE + """SELECT report_id, reporter_id, message_id, abuse_type,
  safety_mode, false AS is_auto FROM parents""")
ORACLE["expand_related"] = _dialog_sql(_FULL_REPORTS_CTE + """SELECT report_id, parent_id, message_id, abuse_type,
  harassment_type, imminent_danger, other_details, safety_mode, block_requested FROM allrep""")
ORACLE["block_sets"] = _dialog_sql(_FULL_REPORTS_CTE + """SELECT a.report_id,
  coalesce(array_to_string(list_sort(list_distinct(list(b.name) FILTER (WHERE b.name IS NOT NULL))), ','), '') AS block_user
FROM allrep a LEFT JOIN blocked b ON b.report_id = a.report_id GROUP BY a.report_id""")
ORACLE["list_my_reports"] = _dialog_sql(_FULL_REPORTS_CTE + """SELECT d.author_id, a.report_id, a.report_seq, a.position
FROM (SELECT DISTINCT author_id FROM dm) d LEFT JOIN allrep a ON a.reporter_id = d.author_id""")


ORACLE["post_report"] = _dialog_sql(_FULL_REPORTS_CTE + """SELECT
  CAST(('0x' || substr(sha256(report_id), 1, 15)) AS BIGINT) AS post_id, report_id FROM allrep""")


def _format_report_sql() -> str:
    nl, tab = "chr(10)", "chr(9)"

    def pybool(e):
        return f"CASE WHEN {e} THEN 'True' ELSE 'False' END"
    sub = (f"CASE WHEN a.abuse_type = 'Other' THEN {tab} || {tab} || 'Abuse Type Details: ' || "
           f"coalesce(a.other_details, 'None') || {nl} "
           f"WHEN a.abuse_type = 'Harassment' THEN {tab} || {tab} || 'Harassment Type: ' || "
           f"coalesce(a.harassment_type, 'None') || {nl} || {tab} || {tab} || 'Multiple Harassers: ' || "
           f"coalesce({pybool('a.multiple_harassers')}, 'None') || {nl} "
           f"WHEN a.abuse_type = 'Imminent Danger' THEN {tab} || {tab} || 'Imminent Danger Type: ' || "
           f"coalesce(a.imminent_danger, 'None') || {nl} ELSE '' END")
    followers = f"coalesce(CAST(floor(c.c_acctbal) AS BIGINT), {RE.DEFAULT_FOLLOWERS})"
    emoji = f"CASE WHEN {followers} > {RE.LARGE_ACCOUNT_FOLLOWERS} THEN '{RE.STRIKE_LARGE}' ELSE '{RE.STRIKE_SMALL}' END"
    blocked = ("EXISTS (SELECT 1 FROM blocked b WHERE b.report_id = a.report_id AND b.name = m.author_name)")
    text = " || ".join([
        "'Report ' || a.report_id || ' at time '",
        f"strftime(TIMESTAMP '{S.EPOCH}' + to_minutes(a.report_seq), '%Y-%m-%d %H:%M:%S')",
        f"':' || {nl} || {tab} || 'Reported message:' || {nl} || {tab}",
        "coalesce(m.author_name, '') || ': \"' || coalesce(m.content, '') || '\"'",
        f"{nl} || {tab} || 'Link:' || coalesce(m.jump_url, '')",
        f"{nl} || {tab} || 'Reporter: ' || 'Reporter#' || CAST(a.reporter_id AS VARCHAR)",
        f"{nl} || {tab} || 'Abuse Type: ' || a.abuse_type || {nl}",
        f"({sub})",
        f"{tab} || 'Has reporter turned on safety mode: ' || {pybool('a.safety_mode')}",
        f"{nl} || {tab} || 'Has reporter blocked message sender: ' || {pybool(blocked)}",
        f"{nl} || 'Press ⏱️ to place abuser under slow mode.' || {nl}",
        f"'Press 🛑 to block abuser for reporter.' || {nl}",
        f"'Press 🗑️ to delete the message.' || {nl} || 'Press ' || {emoji}",
        f"' to send strike and warning to abuser.' || {nl} || 'Press ❌ to ban abuser.' || {nl}",
        f"'Press ❔ to strike reporter for false report. (Only strike if false report is intentional and malicious)' || {nl}",
        "'Press ⬆️ to escalate to a specialized team that handles organized harassment'",
    ])
    return _dialog_sql(_FULL_REPORTS_CTE + f"""SELECT a.report_id, {text} AS report_text
FROM allrep a LEFT JOIN messages m ON m.message_id = a.message_id
LEFT JOIN customer c ON c.c_name = m.author_name""")


ORACLE["format_report"] = _format_report_sql()


def _search_report_sql() -> str:
    nl, tab = "chr(10)", "chr(9)"

    def pybool(e):
        return f"CASE WHEN {e} THEN 'True' ELSE 'False' END"
    sub = (f"CASE WHEN a.abuse_type = 'Other' THEN {tab} || {tab} || 'Abuse Type Details: ' || "
           f"coalesce(a.other_details, 'None') || {nl} "
           f"WHEN a.abuse_type = 'Harassment' THEN {tab} || {tab} || 'Harassment Type: ' || "
           f"coalesce(a.harassment_type, 'None') || {nl} || {tab} || {tab} || 'Multiple Harassers: ' || "
           f"coalesce({pybool('a.multiple_harassers')}, 'None') || {nl} "
           f"WHEN a.abuse_type = 'Imminent Danger' THEN {tab} || {tab} || 'Imminent Danger Type: ' || "
           f"coalesce(a.imminent_danger, 'None') || {nl} ELSE '' END")
    blocked = ("(st.blocked OR EXISTS (SELECT 1 FROM blocked b WHERE b.report_id = a.report_id AND b.name = m.author_name))")
    details = " || ".join([
        "'Report ' || a.report_id || ' at time '",
        f"strftime(TIMESTAMP '{S.EPOCH}' + to_minutes(a.report_seq), '%Y-%m-%d %H:%M:%S')",
        f"':' || {nl} || {tab} || 'Reported message:' || {nl} || {tab}",
        "coalesce(m.author_name, '') || ': \"' || coalesce(m.content, '') || '\"'",
        f"{nl} || {tab} || 'Link:' || coalesce(m.jump_url, '')",
        f"{nl} || {tab} || 'Reporter: ' || 'Reporter#' || CAST(a.reporter_id AS VARCHAR)",
        f"{nl} || {tab} || 'Abuse Type: ' || a.abuse_type || {nl}",
        f"({sub})",
        f"{tab} || 'Has reporter turned on safety mode: ' || {pybool('a.safety_mode')}",
        f"{nl} || {tab} || 'Is this a false report: ' || {pybool('st.false_report_strike')}",
        f"{nl} || {tab} || 'Has the sender been placed on slow mode: ' || {pybool('st.slow_mode')}",
        f"{nl} || {tab} || 'Has the sender been blocked: ' || {pybool(blocked)}",
        f"{nl} || {tab} || 'Has the message been deleted: ' || {pybool('st.deleted')}",
        f"{nl} || {tab} || 'Has the message sender been given a strike: ' || {pybool('st.strike')}",
        f"{nl} || {tab} || 'Has the message been escalated: ' || {pybool('st.escalation')} || {nl}",
    ])
    usage = Q.lit(RE.SEARCH_USAGE)
    invalid = Q.lit(RE.SEARCH_INVALID)
    emojis = "[" + ", ".join(Q.lit(x) for x in AC.ACTION_SET) + "]"
    return _dialog_sql(_FULL_REPORTS_CTE + f""",
acted AS (
  SELECT *, ({emojis})[action_seq % 8 + 1] AS emoji FROM (
    SELECT a.report_id, a.reporter_id, a.reporter_id * 10000 + a.report_seq * 10 + a.position AS action_seq,
           TIMESTAMP '{S.EPOCH}' + to_minutes(a.report_seq) AS report_created_at,
           TRY_CAST(substr(m.author_name, 10) AS BIGINT) AS abuser_id
    FROM allrep a LEFT JOIN messages m ON m.message_id = a.message_id) x
),
{Q.strikes_replay_ctes("abuse", "(SELECT * FROM acted WHERE emoji IN ('❗', '‼️'))", "abuser_id", "report_created_at", "action_seq", 365)},
{Q.strikes_replay_ctes("falses", "(SELECT * FROM acted WHERE emoji = '❔')", "reporter_id", "report_created_at", "action_seq", 30)},
st AS (
  SELECT report_id, bool_or(emoji = '⏱️') AS slow_mode, bool_or(emoji = '🛑') AS blocked, bool_or(emoji = '🗑️') AS deleted,
         bool_or(emoji = '⬆️') AS escalation, bool_or(emoji IN ('❗', '‼️')) AS strike,
         bool_or(emoji = '❔' AND coalesce(f.n_strikes < 3, false)) AS false_report_strike
  FROM acted c LEFT JOIN falses f ON f.seq = c.action_seq GROUP BY report_id
),
det AS (
  SELECT a.report_id, a.reporter_id, lower(replace(a.report_id, '-', '')) AS u, {details} AS details
  FROM allrep a LEFT JOIN messages m ON m.message_id = a.message_id JOIN st ON st.report_id = a.report_id
),
req AS (
  SELECT reporter_id AS author_id, 'search ' || report_id AS content FROM allrep UNION ALL
  SELECT reporter_id + 1, 'search ' || report_id FROM allrep UNION ALL
  SELECT reporter_id, 'search not-an-id' FROM allrep UNION ALL
  SELECT reporter_id, 'search' FROM allrep
),
q AS (
  SELECT author_id, content, string_split({Q.strip('content')}, ' ') AS toks FROM req
)
SELECT q.author_id, q.content,
  CASE WHEN len(q.toks) <> 2 THEN {usage}
       WHEN NOT coalesce(regexp_matches(q.toks[2], {Q.lit(RE.UUID_PATTERN)}), false) THEN NULL
       WHEN d.report_id IS NULL OR d.reporter_id <> q.author_id THEN {invalid}
       ELSE d.details END AS reply
FROM q LEFT JOIN det d ON d.u = lower(replace(q.toks[2], '-', ''))""")


ORACLE["search_report"] = _search_report_sql()


@register("strike_balance_replay", f"""WITH RECURSIVE ev AS (
  SELECT o_custkey AS k, o_orderkey AS seq, epoch_us(o_orderdate) AS t,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
  FROM orders),
r(k, rn, q) AS (
  SELECT k, rn, [t] FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn,
         list_append(list_slice(r.q,
            coalesce(list_position(list_transform(r.q, lambda y: e.t - y < {365 * ST.DAY_US}), true),
                     len(r.q) + 1), len(r.q)), e.t)
  FROM r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1
),
final AS (SELECT k, arg_max(q, rn) AS q FROM r GROUP BY k),
bal AS (
  SELECT k, CAST(len(q) + 1 - coalesce(list_position(list_transform(q,
            lambda y: epoch_us(TIMESTAMP '{S.BALANCE_AS_OF}') - y < {365 * ST.DAY_US}), true), len(q) + 1)
         AS BIGINT) AS n FROM final
)
SELECT c.c_custkey, coalesce(b.n, 0) AS abuse_strikes
FROM customer c LEFT JOIN bal b ON b.k = c.c_custkey""")
def q_strike_balance_replay(spark, sf_dir):
    users = S.table(spark, sf_dir, "customer").select("c_custkey")
    o = S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey",
                                                "o_orderdate")
    return ST.strike_balance_replay(users, o, "c_custkey", "o_orderdate", "o_orderkey",
                                    S.BALANCE_AS_OF, 365, "abuse_strikes")
