"""Conversations and answer critique."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..operators import conversations as cv
from ..registry import operation
from ..sources.tables import fixture, table

KEEP = 3           # most conversations of the given table are short, so fewer turns than usual are kept
CAP_TOKENS = 400


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Messages with a user turn that follows an assistant turn taken as an answer to a tool call."""
    return _messages(spark, sf).withColumn("orphan", (F.col("role") == "user") & (F.col("turn") % 4 == 2))


_MARKED = "m AS (SELECT *, role = 'user' AND turn % 4 = 2 AS orphan FROM conversations)"


@operation("WIN-3", sql=f"""
SELECT conv_id, turn, role, text, CASE WHEN rn <= {KEEP} THEN 'recent' ELSE 'old' END AS part FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)""")
def recent_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Messages split into the last turns and the older ones."""
    return cv.split_recent(_messages(spark, sf), KEEP)


@operation("WIN-4", sql=f"""
WITH {_MARKED},
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m),
w AS (SELECT conv_id, min(turn) AS wanted FROM r WHERE rn <= {KEEP} GROUP BY 1)
SELECT m.conv_id, count(*) AS n_turns,
  coalesce(max(turn) FILTER (WHERE turn <= wanted AND NOT orphan), min(turn)) AS split_turn
FROM m JOIN w ON m.conv_id = w.conv_id GROUP BY 1""")
def safe_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Turn at which the kept part begins, never on an answer to a tool call."""
    return cv.recent_starts(_marked(spark, sf), KEEP)


_TRIMMED = f"""
WITH {_MARKED},
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tail,
        sum(length(text)) OVER (PARTITION BY conv_id) AS n_chars FROM m),
b AS (SELECT conv_id, max(n_chars) AS n_chars, min(turn) AS oldest, max(turn) AS newest,
        max(turn) FILTER (WHERE tail > {4 * CAP_TOKENS}) AS too_old,
        min(turn) FILTER (WHERE tail <= {4 * CAP_TOKENS} AND NOT orphan) AS head FROM s GROUP BY conv_id),
f AS (SELECT conv_id, CAST(n_chars AS BIGINT) AS n_chars, CASE WHEN n_chars < {3 * CAP_TOKENS} OR too_old IS NULL THEN oldest
        ELSE coalesce(head, newest) END AS first_turn FROM b)
"""


@operation("WIN-5", sql=_TRIMMED + "SELECT * FROM f")
def trim_points(spark: SparkSession, sf: str) -> DataFrame:
    """First message each conversation keeps within the budget."""
    return cv.trim_starts(_marked(spark, sf), CAP_TOKENS)


@operation("WIN-5", sql=_TRIMMED + """
SELECT m.conv_id, turn, role, text, orphan FROM m JOIN f ON m.conv_id = f.conv_id WHERE turn >= first_turn""")
def trimmed_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Messages left after trimming every conversation to the budget."""
    return cv.trim_to_budget(_marked(spark, sf), CAP_TOKENS)


@operation("WIN-6", sql=f"""
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, sum(length(text)) < {3 * CAP_TOKENS} AS needs_no_action
FROM conversations GROUP BY conv_id""")
def rough_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Characters per conversation and the cheap gate."""
    return cv.rough_sizes(_messages(spark, sf), CAP_TOKENS)


@operation("WIN-7", sql="""
SELECT conv_id, turn // 1000 AS part, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY 1, 2""")
def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as text."""
    return cv.transcripts(_messages(spark, sf))


@operation("WIN-8", sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
o AS (SELECT conv_id, count(*) AS n_old, min(text) AS summary FROM r WHERE rn > {KEEP} GROUP BY 1)
SELECT conv_id, CAST(-2 AS BIGINT) AS position, 'user' AS role,
  '[Summary of ' || CAST(n_old AS varchar) || ' earlier turns]' || chr(10) || chr(10) || summary AS text FROM o
UNION ALL SELECT conv_id, -1, 'assistant', 'Understood — continuing from that summary.' FROM o
UNION ALL SELECT conv_id, turn, role, text FROM r WHERE rn <= {KEEP}""")
def condensed_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Older turns replaced by a summary pair; the summaries are a column computed elsewhere."""
    messages = _messages(spark, sf)
    old = cv.split_recent(messages, KEEP).where("part = 'old'")
    return cv.condense(messages, old.groupBy("conv_id").agg(F.min("text").alias("summary")), KEEP)


@operation("WIN-4", uses=["block_messages"], sql=f"""+
m AS (SELECT conv_id, turn, role = 'user' AND coalesce(json_type(content) = 'ARRAY' AND
    list_contains(json_extract_string(content, '$[*].type'), 'tool_result'), false) AS orphan FROM block_messages),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m),
w AS (SELECT conv_id, min(turn) AS wanted FROM r WHERE rn <= {KEEP} GROUP BY 1)
SELECT m.conv_id, count(*) AS n_turns,
  coalesce(max(turn) FILTER (WHERE turn <= wanted AND NOT orphan), min(turn)) AS split_turn
FROM m JOIN w ON m.conv_id = w.conv_id GROUP BY 1""")
def block_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Where the kept part begins in conversations whose messages are made of blocks."""
    return cv.recent_starts(cv.from_content(fixture(spark, sf, "block_messages")), KEEP)


@operation("WIN-7", uses=["block_messages"], sql="""+
b AS (SELECT conv_id, turn, unnest(json_extract(content, '$[*]')) AS b, unnest(range(CAST(json_array_length(content) AS BIGINT))) AS i
  FROM block_messages WHERE json_type(content) = 'ARRAY'),
p AS (SELECT conv_id, turn, i, CASE b ->> '$.type' WHEN 'text' THEN b ->> '$.text'
    WHEN 'tool_use' THEN '[called tool: ' || coalesce(b ->> '$.name', '?') || ']'
    WHEN 'tool_result' THEN '[tool result: ' || CASE WHEN length(b ->> '$.content') > 200 THEN substr(b ->> '$.content', 1, 200) || '…'
      ELSE b ->> '$.content' END || ']' WHEN 'image' THEN '[image]' END AS part FROM b),
j AS (SELECT conv_id, turn, string_agg(part, chr(10) ORDER BY i) AS body FROM p WHERE part <> '' GROUP BY 1, 2)
SELECT m.conv_id, m.turn, upper(role) || ': ' || CASE WHEN json_type(content) = 'ARRAY' THEN coalesce(body, '')
  ELSE coalesce(content ->> '$', '') END AS line FROM block_messages m LEFT JOIN j ON m.conv_id = j.conv_id AND m.turn = j.turn""")
def block_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line of every message made of blocks; a transcript is the lines of a conversation by turn."""
    return cv.transcript_lines(cv.from_content(fixture(spark, sf, "block_messages")))


@operation("WIN-8", sql=f"""
WITH {_MARKED},
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m),
w AS (SELECT conv_id, min(turn) AS wanted FROM r WHERE rn <= {KEEP} GROUP BY 1),
g AS (SELECT m.conv_id, sum(length(text)) > {4 * CAP_TOKENS} AS over_cap,
    coalesce(max(turn) FILTER (WHERE turn <= wanted AND NOT orphan), min(turn)) AS split FROM m JOIN w ON m.conv_id = w.conv_id GROUP BY 1),
s AS (SELECT m.conv_id, min(text) AS summary FROM m JOIN g ON m.conv_id = g.conv_id
  WHERE turn < split AND m.conv_id % 5 <> 0 GROUP BY 1),
p AS (SELECT g.conv_id, over_cap, CASE WHEN over_cap AND summary IS NOT NULL THEN split END AS split, summary
  FROM g LEFT JOIN s ON g.conv_id = s.conv_id),
c AS (SELECT m.conv_id, turn AS position, role, text, orphan FROM m JOIN p ON m.conv_id = p.conv_id WHERE turn >= coalesce(split, 0)
  UNION ALL SELECT conv_id, -2, 'user', '[Summary of ' || CAST(split AS varchar) || ' earlier turns]' || chr(10) || chr(10) || summary, false
  FROM p WHERE split IS NOT NULL
  UNION ALL SELECT conv_id, -1, 'assistant', '{cv.SUMMARY_REPLY}', false FROM p WHERE split IS NOT NULL),
t AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY position DESC) AS tail FROM c),
f AS (SELECT conv_id, CASE WHEN max(tail) <= {4 * CAP_TOKENS} THEN min(position) ELSE
    coalesce(min(position) FILTER (WHERE tail <= {4 * CAP_TOKENS} AND NOT orphan), max(position)) END AS head FROM t GROUP BY 1)
SELECT c.conv_id, position, role, text, CASE WHEN NOT over_cap THEN 'keep' WHEN split IS NULL THEN 'trim'
  WHEN head = -2 THEN 'condense' ELSE 'condense_trim' END AS action
FROM c JOIN f ON c.conv_id = f.conv_id JOIN p ON c.conv_id = p.conv_id WHERE position >= head""")
def budgeted_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations kept, condensed or trimmed to the budget; every fifth has no summary."""
    messages = _marked(spark, sf)
    old = cv.split_recent(messages, KEEP).where("part = 'old' AND conv_id % 5 <> 0")
    return cv.fit_to_budget(messages, old.groupBy("conv_id").agg(F.min("text").alias("summary")), CAP_TOKENS, KEEP)


_PHRASES = " OR ".join("contains(lower(answer), '{}')".format(p.replace("'", "''")) for p in cv.GIVE_UP_PHRASES)


@operation("TXT-8", uses=["qa_pairs"], sql=f"""+
c AS (SELECT conv_id, turn, question, answer, {_PHRASES} AS gave_up, length(answer) < 40 AS thin FROM qa_pairs)
SELECT conv_id, turn, CAST(CASE WHEN gave_up OR thin THEN 4 ELSE 6 END AS BIGINT) AS rating,
  CASE WHEN gave_up AND thin THEN '{cv.GAVE_UP}|{cv.THIN}' WHEN gave_up THEN '{cv.GAVE_UP}'
    WHEN thin THEN '{cv.THIN}' ELSE '{cv.NO_CRITIC}' END AS weaknesses, '{cv.PLAIN_LESSON}' AS lesson FROM c""")
def answer_critiques(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-based review of every answer to a user message."""
    pairs = cv.question_answers(_messages(spark, sf)).withColumn("feedback", F.lit(""))
    return cv.critique(pairs).select("conv_id", "turn", "rating", F.array_join("weaknesses", "|").alias("weaknesses"),
                                     "lesson")


@operation("TXT-8", uses=["qa_pairs"], sql=f"""+
f AS (SELECT q.conv_id, q.turn, question, answer, coalesce(n.text, '') AS feedback FROM qa_pairs q
  LEFT JOIN conversations n ON n.conv_id = q.conv_id AND n.turn = q.turn + 2 AND n.role = 'user'),
c AS (SELECT *, {_PHRASES} AS gave_up, length(answer) < 40 AS thin FROM f)
SELECT conv_id, turn, CAST(CASE WHEN gave_up OR thin OR feedback <> '' THEN 4 ELSE 6 END AS BIGINT) AS rating,
  coalesce(nullif(array_to_string([x for x in [CASE WHEN gave_up THEN '{cv.GAVE_UP}' END,
    CASE WHEN feedback <> '' THEN '{cv.FLAGGED}' || substr(feedback, 1, 200) END,
    CASE WHEN thin THEN '{cv.THIN}' END] if x IS NOT NULL], '|'), ''), '{cv.NO_CRITIC}') AS weaknesses,
  CASE WHEN feedback <> '' THEN 'When asked something like ''' || substr(question, 1, 80) ||
    ''', verify with tools first and address the user''s feedback directly.' ELSE '{cv.PLAIN_LESSON}' END AS lesson FROM c""")
def critiques_with_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Review of every answer, the next user message taken as feedback on it."""
    messages = _messages(spark, sf)
    pairs = cv.question_answers(messages)
    said = messages.where("role = 'user'").select("conv_id", (F.col("turn") - 2).alias("turn"),
                                                  F.col("text").alias("feedback"))
    return cv.critique(pairs.join(said, ["conv_id", "turn"], "left")).select(
        "conv_id", "turn", "rating", F.array_join("weaknesses", "|").alias("weaknesses"), "lesson")


@operation("TXT-7", uses=["payloads"], sql="""
SELECT event_id, CASE WHEN body LIKE '{"%' THEN body END AS object FROM payloads""")
def extracted_objects(spark: SparkSession, sf: str) -> DataFrame:
    """JSON objects found in fenced answers."""
    fenced = F.concat(F.lit("```json\n"), F.col("body"), F.lit("\n```"))
    return fixture(spark, sf, "payloads").select("event_id", pl.extract_object(fenced).alias("object"))
