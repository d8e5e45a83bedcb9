"""SQL spellings (DuckDB dialect) of the Column functions, for the oracle.

They are generated from the same tables the Spark functions use, so both
engines fold, strip and match with identical character sets.
"""

from __future__ import annotations

from ..functions.folding import fold_tables, python_whitespace
from . import standins as S


def lit(s: str) -> str:
    """A SQL string literal; control characters spelled with chr()."""
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32 or 0x7F <= ord(ch) < 0xA0:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {lit(python_whitespace())})"


def fold(e: str) -> str:
    src, dst, multi = fold_tables()
    out = f"translate({e}, {lit(src)}, {lit(dst)})"
    for ch, rep in multi:
        out = f"replace({out}, {lit(ch)}, {lit(rep)})"
    return out


def values(col: str, items: list[str]) -> str:
    rows = ", ".join(f"({lit(x)})" for x in items)
    return f"(VALUES {rows}) AS v({col})"


MESSAGES = f"""
messages AS (
  SELECT doc_id + {S.ID_BASE} AS message_id,
         CASE WHEN src_no <> 0 THEN doc_id % 25 END AS guild_id,
         coalesce(CASE WHEN src_no <> 0 THEN doc_id % 25 END, 99) * 100 + src_no AS channel_id,
         CASE WHEN src_no = 18 THEN 'group-{S.GROUP}-human-mod'
              WHEN src_no = 19 THEN 'group-{S.GROUP}-mod'
              ELSE 'group-' || CAST(src_no AS VARCHAR) END AS channel_name,
         doc_id % 500 AS author_id,
         'Customer#' || lpad(CAST(doc_id % 500 AS VARCHAR), 9, '0') AS author_name,
         text || CASE WHEN doc_id % 17 = 0
                      THEN ' He lives at ' || CAST(doc_id % 900 + 100 AS VARCHAR) || ' Maple Street.'
                      ELSE '' END AS content,
         TIMESTAMP '{S.EPOCH}' + to_minutes(doc_id) AS created_at,
         '{S.LINK_BASE}' || coalesce(CAST(CASE WHEN src_no <> 0 THEN doc_id % 25 END AS VARCHAR), '@me')
           || '/' || CAST(coalesce(CASE WHEN src_no <> 0 THEN doc_id % 25 END, 99) * 100 + src_no AS VARCHAR)
           || '/' || CAST(doc_id + {S.ID_BASE} AS VARCHAR) AS jump_url
  FROM (SELECT *, TRY_CAST(substr(source, 4, 16) AS BIGINT) AS src_no FROM documents) d
)"""

NORM = f"""
norm AS (
  SELECT *, lower(folded) AS lowered FROM (
    SELECT *, {fold('stripped')} AS folded FROM (
      SELECT *, {strip('content')} AS stripped FROM messages) a) b
)"""

TERM_HITS = f"""
term_hits AS (
  SELECT n.message_id, v.term, instr(n.lowered, v.term) - 1 AS hit_start,
         instr(n.lowered, v.term) - 1 + length(v.term) AS hit_end
  FROM norm n JOIN {values('term', S.TEST_TERMS)} ON instr(n.lowered, v.term) > 0
)"""

LARGE_TERMS = f"""
raw_terms AS (
  SELECT substr(text, (doc_id * 31 + j * 97) % greatest(length(text) - 20, 1) + 1, n) AS term
  FROM documents, (SELECT unnest({S.PASSAGE_LENGTHS}) AS n, unnest(range({len(S.PASSAGE_LENGTHS)})) AS j) v
  UNION SELECT CAST(c_nationkey % 10 AS VARCHAR) FROM customer
  UNION SELECT CAST(c_nationkey + 10 AS VARCHAR) FROM customer
),
large_terms AS (SELECT DISTINCT lower({strip('term')}) AS term FROM raw_terms WHERE length({strip('term')}) > 0)"""

LARGE_HITS = LARGE_TERMS + """,
term_hits AS (
  SELECT n.message_id, v.term, instr(n.lowered, v.term) - 1 AS hit_start,
         instr(n.lowered, v.term) - 1 + length(v.term) AS hit_end
  FROM norm n JOIN large_terms v ON instr(n.lowered, v.term) > 0
)"""

FIRST_TERM = """
first_term AS (
  SELECT message_id, term, hit_start, hit_end FROM (
    SELECT *, row_number() OVER (PARTITION BY message_id
                                 ORDER BY hit_start, length(term) DESC, term) AS rn
    FROM term_hits) x WHERE rn = 1
)"""


def highlight(orig: str, start: str, end: str) -> str:
    return (f"substring({orig}, 1, {start}) || '`' || substring({orig}, {start} + 1, "
            f"greatest({end} - {start}, 0)) || '`' || substring({orig}, {end} + 1)")


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def attribute_reply_sql(idc: str) -> str:
    parts = [f"'\"{a}\": {{\"summaryScore\": {{\"value\": 0.' || lpad(CAST((({idc} % 1000) * {m} + {o}) % 1000 AS VARCHAR), 3, '0') || '}}}}'"
             for a, m, o in S.ATTR_RULES]
    body = " || ', ' || ".join(parts[:-1])
    return (f"CASE WHEN {idc} % 13 <> 0 THEN '{{\"attributeScores\": {{' || {body} || "
            f"CASE WHEN {idc} % 11 = 0 THEN '' ELSE ', ' || {parts[-1]} END || '}}}}' END")


def chat_reply_sql(idc: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(S.CHAT_TEXTS))
    return (f"CASE WHEN {idc} % 19 <> 0 THEN '{{\"choices\": [{{\"message\": {{\"content\": \"' || "
            f"(CASE {idc} % 6 {cases} END) || '\"}}}}]}}' END")


def attr_score_sql(reply: str, attr: str) -> str:
    return f"TRY_CAST(json_extract_string({reply}, '$.attributeScores.{attr}.summaryScore.value') AS DOUBLE)"


def chat_content_sql(reply: str) -> str:
    return f"json_extract_string({reply}, '$.choices[0].message.content')"


def threshold_first_sql(score_cols: dict[str, str], thresholds) -> str:
    whens = " ".join(f"WHEN {score_cols[a]} > CAST({t!r} AS DOUBLE) THEN '{a}'" for a, t in thresholds)
    return f"CASE {whens} END"


def scores_cte(name: str = "scores", src: str = "messages", idc: str = "message_id") -> str:
    return f"""
{name} AS (
  SELECT {idc}, attr_reply, chat_reply,
         {attr_score_sql('attr_reply', 'TOXICITY')} AS s_toxicity,
         {attr_score_sql('attr_reply', 'SPAM')} AS s_spam,
         {attr_score_sql('attr_reply', 'IDENTITY_ATTACK')} AS s_identity_attack,
         {attr_score_sql('attr_reply', 'INSULT')} AS s_insult,
         {attr_score_sql('attr_reply', 'THREAT')} AS s_threat,
         {chat_content_sql('chat_reply')} AS chat_content
  FROM (SELECT {idc}, {attribute_reply_sql(idc)} AS attr_reply,
               {chat_reply_sql(idc)} AS chat_reply FROM {src}) r
)"""


SCORES = scores_cte()

SCORE_COLS = {"TOXICITY": "s_toxicity", "SPAM": "s_spam", "IDENTITY_ATTACK": "s_identity_attack",
              "INSULT": "s_insult", "THREAT": "s_threat"}


def regex_hits_cte() -> str:
    pats = values("pattern", S.TEST_PATTERNS)
    return f"""
regex_hits AS (
  SELECT n.message_id, v.pattern,
         instr(n.folded, regexp_extract(n.folded, v.pattern)) - 1 AS hit_start,
         instr(n.folded, regexp_extract(n.folded, v.pattern)) - 1
           + length(regexp_extract(n.folded, v.pattern)) AS hit_end
  FROM norm n JOIN {pats} ON regexp_matches(n.folded, v.pattern)
),
first_regex AS (
  SELECT message_id, pattern, hit_start, hit_end FROM (
    SELECT *, row_number() OVER (PARTITION BY message_id
                                 ORDER BY hit_start, hit_end - hit_start DESC, pattern) AS rn
    FROM regex_hits) x WHERE rn = 1
)"""


def pii_sql(e: str) -> str:
    alt = "|".join(f"(?:{r})" for r in S.TEST_PII_RULES)
    return f"regexp_matches({e}, {lit(alt)})"


LINES = """
lines AS (
  SELECT d.doc_id AS post_id,
         replace(d.text, chr(10), ' ') || ',' ||
         CASE WHEN l.toxic = 1 THEN 'cyberbullying' ELSE 'not_cyberbullying' END AS value
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
posts AS (
  SELECT post_id, left(value, length(value) - length(label) - 1) AS post, label,
         label <> 'not_cyberbullying' AS is_positive
  FROM (SELECT *, regexp_extract(value, ',([^,]*)$', 1) AS label FROM lines WHERE contains(value, ',')) x
)"""


def order_key_sql(idc: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({idc} AS VARCHAR) || ':{S.SEED}'), 1, 15)) AS BIGINT)"


# the word scorer: counts per word, log-odds in thousandths, mean per text
WORD_WEIGHTS = """
post_words AS (
  SELECT p.post_id, p.is_positive AS y, unnest(list_distinct(regexp_extract_all(lower(p.post), '[a-z]+'))) AS word FROM posts p
),
word_counts AS (SELECT word, count_if(y) AS pos, count_if(NOT y) AS neg FROM post_words GROUP BY word),
word_totals AS (SELECT sum(pos) AS p, sum(neg) AS n, count(*) AS v FROM word_counts),
weights AS (
  SELECT word, CAST(round((ln((pos + 1)::DOUBLE / (neg + 1)::DOUBLE) + ln((n + v)::DOUBLE / (p + v)::DOUBLE)) * 1000) AS BIGINT) AS weight
  FROM word_counts, word_totals
)"""


def text_scores_cte(name: str, src: str, idc: str, text: str) -> str:
    return f"""
{name} AS (
  SELECT t.{idc}, round(coalesce(1 / (1 + exp(-s.logit * 10)), 0.5::DOUBLE), 6) AS score
  FROM {src} t LEFT JOIN (
    SELECT w.{idc}, sum(x.weight)::DOUBLE / (count(*) * 1000)::DOUBLE AS logit
    FROM (SELECT {idc}, unnest(list_distinct(regexp_extract_all(lower({text}), '[a-z]+'))) AS word FROM {src}) w
    JOIN weights x ON x.word = w.word GROUP BY w.{idc}) s ON s.{idc} = t.{idc}
)"""


ACTIONS = f"""
actions AS (
  SELECT xor(event_id, {S.ORDER_FLIP}) AS action_seq, ts AS acted_at,
         CASE WHEN event_id % 50 = 0 THEN CAST({S.BOT_ID} AS BIGINT) ELSE user_id % 7 + 1 END AS actor_id,
         user_id % 25 AS guild_id,
         CASE WHEN event_id % 23 = 0 THEN (user_id % 25) * 100 + 3 ELSE (user_id % 25) * 100 + 18 END AS channel_id,
         user_id * 1000 + dayofyear(ts) + CASE WHEN event_id % 37 = 0 THEN 500 ELSE 0 END AS post_id,
         ({'[' + ', '.join(lit(x) for x in S.ACTION_EMOJIS + [S.OTHER_EMOJI]) + ']'})[(event_id + user_id) % 9 + 1] AS emoji
  FROM events
),
reports AS (
  SELECT 'R' || CAST(post_id AS VARCHAR) AS report_id, post_id, u AS abuser_id,
         'Customer#' || lpad(CAST(u AS VARCHAR), 9, '0') AS abuser_name,
         CASE WHEN u % 5 <> 0 THEN (u * 7 + 3) % 150 END AS reporter_id,
         u % 5 = 0 AS is_auto,
         TIMESTAMP '{S.EPOCH}' + to_days(CAST(post_id % 1000 - 1 AS INTEGER)) AS report_created_at,
         ({'[' + ', '.join(lit(S.REPORT_CATEGORIES[k]) for k in sorted(S.REPORT_CATEGORIES)) + ']'})[post_id % 6 + 1] AS abuse_type,
         '{S.LINK_BASE}0/0/' || CAST(post_id AS VARCHAR) AS jump_url,
         'reported message ' || CAST(post_id AS VARCHAR) AS content
  FROM (SELECT DISTINCT post_id, CAST(post_id // 1000 AS BIGINT) AS u
        FROM (SELECT user_id * 1000 + dayofyear(ts) AS post_id FROM events) e) p
),
report_posts AS (SELECT post_id, report_id FROM reports)"""


def strikes_window_sql(src: str, key: str, created: str, seq: str, days: int, cols: str) -> str:
    h = days * 86_400_000_000
    return f"""SELECT {cols},
  count(*) OVER (PARTITION BY {key} ORDER BY epoch_us({created}) RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW)
  - (count(*) OVER (PARTITION BY {key}, {created})
     - row_number() OVER (PARTITION BY {key}, {created} ORDER BY {seq})) AS n_strikes
FROM {src}"""


def strikes_replay_ctes(name: str, src: str, key: str, created: str, seq: str, days: int) -> str:
    """``name(seq, k, n_strikes)``: the strike list itself, one step at a time."""
    h = days * 86_400_000_000
    return f"""
{name}_ev AS (
  SELECT {key} AS k, {seq} AS seq, epoch_us({created}) AS t, row_number() OVER (PARTITION BY {key} ORDER BY {seq}) AS rn
  FROM {src} WHERE {key} IS NOT NULL),
{name}_r(k, rn, seq, q) AS (
  SELECT k, rn, seq, [t] FROM {name}_ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.seq,
         list_append(list_slice(r.q,
            coalesce(list_position(list_transform(r.q, lambda y: e.t - y < {h}), true), len(r.q) + 1), len(r.q)), e.t)
  FROM {name}_r r JOIN {name}_ev e ON e.k = r.k AND e.rn = r.rn + 1
),
{name} AS (SELECT seq, k, CAST(len(q) AS BIGINT) AS n_strikes FROM {name}_r)"""


def _arr(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def list_edits_cte() -> str:
    from ..operators.lists import LINE_BREAK
    word = "event_type IN ('click', 'view', 'signup')"
    wv, rv = S.WORD_VOCAB, S.REGEX_VOCAB

    def pick(v, shift):
        return f"({_arr(v)})[(user_id + {shift}) % {len(v)} + 1]"
    return f"""
edits AS (
  SELECT event_id AS edit_seq, ts AS edited_at,
         CASE WHEN {word} THEN 'word' ELSE 'regex' END AS list_kind,
         CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op,
         CASE WHEN {word} THEN {pick(wv, 0)} ELSE {pick(rv, 0)} END
         || CASE WHEN {word} AND event_id % 29 = 0 THEN chr(10) || '  ' ELSE '' END
         || CASE WHEN event_id % 4 = 0 THEN chr(10) || CASE WHEN {word} THEN {pick(wv, 3)} ELSE {pick(rv, 3)} END ELSE '' END
         || CASE WHEN event_id % 7 = 0 THEN chr(10) ELSE '' END AS content
  FROM events
),
split AS (
  SELECT *, regexp_split_to_array(content, {lit(LINE_BREAK)}) AS parts0 FROM edits
),
parts AS (
  SELECT *, CASE WHEN parts0[-1] = '' THEN parts0[1:len(parts0) - 1] ELSE parts0 END AS parts FROM split
),
lines0 AS (
  SELECT edit_seq, edited_at, list_kind, op, unnest(parts) AS raw,
         generate_subscripts(parts, 1) - 1 AS line_no FROM parts
),
lines AS (
  SELECT edit_seq, edited_at, list_kind, op, line_no, raw,
         CASE WHEN list_kind = 'word' THEN lower({strip('raw')}) ELSE raw END AS item,
         CASE WHEN list_kind = 'word' THEN length({strip('raw')}) > 0 ELSE true END AS valid
  FROM lines0
),
seeded AS (
  SELECT edit_seq, edited_at, list_kind, op, line_no, item, valid FROM lines
  UNION ALL
  SELECT DISTINCT CAST(-1 AS BIGINT), CAST(NULL AS TIMESTAMP), 'word', 'add', 0, v.term, true
  FROM {values('term', S.TEST_TERMS)}
),
st AS (
  SELECT *, lag(op) OVER (PARTITION BY list_kind, item ORDER BY edit_seq, line_no) AS prev_op
  FROM seeded WHERE valid
),
statuses AS (
  SELECT edit_seq, edited_at, line_no, list_kind, item,
         CASE WHEN op = 'add' AND prev_op = 'add' THEN 'already' WHEN op = 'add' THEN 'added'
              WHEN prev_op = 'add' THEN 'removed' ELSE 'missing' END AS status
  FROM st
  UNION ALL
  SELECT edit_seq, edited_at, line_no, list_kind, item, 'invalid' FROM seeded WHERE NOT valid
),
current_items AS (
  SELECT list_kind, item FROM (
    SELECT list_kind, item, arg_max(op, edit_seq * 1000 + line_no) AS last_op FROM seeded WHERE valid
    GROUP BY list_kind, item) x WHERE last_op = 'add'
)"""
