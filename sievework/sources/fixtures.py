"""Dirty projections of the given tables.

Every text runs unchanged on Spark SQL and on any ANSI engine over the same Parquet views.  Defects
are injected by key arithmetic, so a projection grows with its table and never changes between runs.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["dirty_customers"] = """
WITH d AS (
  SELECT c_custkey AS k,
    CASE WHEN c_custkey % 67 = 10 THEN concat(' C', cast(c_custkey AS string), ' ')
         WHEN c_custkey % 67 = 20 THEN concat('c', cast(c_custkey AS string))
         ELSE concat('C', cast(c_custkey AS string)) END AS customer_id,
    CASE WHEN c_custkey % 100 = 7 THEN NULL WHEN c_custkey % 100 = 88 THEN '' ELSE c_name END AS name,
    CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment)
         ELSE concat(' ', c_mktsegment) END AS state,
    2020 + c_custkey % 5 AS y, c_custkey % 12 + 1 AS m, c_custkey % 28 + 1 AS dd,
    CASE WHEN c_custkey % 13 = 0 THEN NULL
         ELSE concat('customer', cast(c_custkey AS string), '@example.com') END AS email
  FROM customer),
e AS (
  SELECT k, customer_id, name, state,
    CASE k % 3
      WHEN 0 THEN concat(cast(y AS string), '-', lpad(cast(m AS string), 2, '0'), '-', lpad(cast(dd AS string), 2, '0'))
      WHEN 1 THEN concat(lpad(cast(m AS string), 2, '0'), '/', lpad(cast(dd AS string), 2, '0'), '/', cast(y AS string))
      ELSE concat(cast(dd AS string), ' ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast((m - 1) * 3 + 1 AS int), 3), ' ', cast(y AS string))
    END AS signup_date, email
  FROM d)
SELECT customer_id, name, state, signup_date, email FROM e
UNION ALL
SELECT customer_id, name, state, signup_date, email FROM e WHERE k % 50 = 3
"""

SQL["dirty_orders"] = """
WITH d AS (
  SELECT o_orderkey AS k, concat('O', cast(o_orderkey AS string)) AS order_id,
    CASE WHEN o_orderkey % 17 = 0 THEN concat('G', cast(o_custkey AS string))
         ELSE concat('C', cast(o_custkey AS string)) END AS customer_id,
    cast(cast(o_totalprice AS decimal(18, 2)) AS string) AS p,
    year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd,
    CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS st
  FROM orders),
e AS (
  SELECT k, order_id, customer_id,
    CASE WHEN k % 250 = 15 THEN NULL WHEN k % 250 = 16 THEN ''
         WHEN k % 3 = 0 THEN p
         WHEN k % 3 = 1 AND length(p) > 6 THEN concat('$', substr(p, 1, cast(length(p) - 6 AS int)), ',', substr(p, cast(length(p) - 5 AS int), 6))
         WHEN k % 3 = 1 THEN concat('$', p)
         ELSE concat('  ', p, ' ') END AS amount,
    CASE k % 3
      WHEN 0 THEN concat(cast(y AS string), '-', lpad(cast(m AS string), 2, '0'), '-', lpad(cast(dd AS string), 2, '0'))
      WHEN 1 THEN concat(lpad(cast(m AS string), 2, '0'), '/', lpad(cast(dd AS string), 2, '0'), '/', cast(y AS string))
      ELSE concat(cast(dd AS string), ' ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast((m - 1) * 3 + 1 AS int), 3), ' ', cast(y AS string))
    END AS order_date,
    CASE k % 3 WHEN 0 THEN st WHEN 1 THEN upper(st) ELSE concat(upper(substr(st, 1, 1)), substr(st, 2, 20)) END AS status
  FROM d)
SELECT order_id, customer_id, amount, order_date, status FROM e
UNION ALL
SELECT order_id, customer_id, amount, order_date, status FROM e WHERE k % 100 = 3
"""

SQL["dirty_items"] = """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS item_id,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL
       ELSE concat('$', cast(cast(l_extendedprice AS decimal(18, 2)) AS string)) END AS price,
  concat(cast(cast(l_discount * 100 AS int) AS string), '%') AS discount,
  CASE WHEN l_orderkey % 8 = 0 THEN '' ELSE cast(cast(l_quantity AS int) AS string) END AS quantity,
  CASE WHEN l_linenumber % 2 = 0
       THEN concat(lpad(cast(month(l_shipdate) AS string), 2, '0'), '/', lpad(cast(day(l_shipdate) AS string), 2, '0'), '/', cast(year(l_shipdate) AS string))
       ELSE concat(cast(year(l_shipdate) AS string), '-', lpad(cast(month(l_shipdate) AS string), 2, '0'), '-', lpad(cast(day(l_shipdate) AS string), 2, '0')) END AS ship_date,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN lower(l_returnflag)
       ELSE concat(l_returnflag, ' ') END AS flag
FROM lineitem
"""

SQL["usage_log"] = """
SELECT event_id, user_id AS conv_id, ts, concat('model-', event_type) AS model,
  event_id % 5000 + 100 AS input_tokens, event_id % 700 + 10 AS output_tokens,
  event_id % 90 AS cache_read, event_id % 40 AS cache_write
FROM events
"""

SQL["payloads"] = """
SELECT event_id, CASE event_id % 11 WHEN 0 THEN '{bad' WHEN 1 THEN '[1,2]' WHEN 2 THEN '' ELSE props END AS body
FROM events
"""

SQL["eval_scores"] = """
SELECT doc_id AS example_id, 'faithfulness' AS metric, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE cast(quality AS double) END AS score FROM labels
UNION ALL
SELECT doc_id, 'relevance', 1.0 - cast(toxic AS double) FROM labels
UNION ALL
SELECT doc_id, 'conciseness', cast(doc_id % 10 AS double) / 10 FROM labels
"""

SQL["feed_v1"] = """
SELECT cast(p_partkey AS string) AS id, p_name AS name, cast(p_size AS string) AS size, p_type AS kind FROM part
"""

SQL["feed_v2"] = """
SELECT cast(p_partkey AS string) AS id, p_name AS name, concat(cast(p_size AS string), ' cm') AS size, p_brand AS brand FROM part
"""

SQL["passages"] = """
SELECT cast(d.doc_id AS string) AS id, d.text AS text, d.source AS source, e.embedding AS embedding
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
"""

SQL["qa_pairs"] = """
SELECT * FROM (
  SELECT conv_id, turn, role, text AS question,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
    lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
  FROM conversations) q
WHERE role = 'user' AND next_role = 'assistant'
"""

SQL["lessons"] = """
SELECT event_id AS lesson_id, ts, concat('prefer ', event_type, ' checks over user ', cast(user_id AS string)) AS lesson,
  event_type AS question, event_id % 10 + 1 AS rating
FROM events
"""

SQL["requests"] = """
SELECT event_id, ts, concat(cast(user_id % 20 AS string), '-', event_type) AS request_key FROM events
"""

# The same items with far more holes: more than a tenth of the cells is missing.
SQL["sparse_items"] = """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS item_id,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL
       ELSE concat('$', cast(cast(l_extendedprice AS decimal(18, 2)) AS string)) END AS price,
  concat(cast(cast(l_discount * 100 AS int) AS string), '%') AS discount,
  CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE cast(cast(l_quantity AS int) AS string) END AS quantity,
  CASE WHEN l_linenumber % 2 = 0
       THEN concat(lpad(cast(month(l_shipdate) AS string), 2, '0'), '/', lpad(cast(day(l_shipdate) AS string), 2, '0'), '/', cast(year(l_shipdate) AS string))
       ELSE concat(cast(year(l_shipdate) AS string), '-', lpad(cast(month(l_shipdate) AS string), 2, '0'), '-', lpad(cast(day(l_shipdate) AS string), 2, '0')) END AS ship_date,
  CASE WHEN l_orderkey % 2 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN lower(l_returnflag)
       ELSE concat(l_returnflag, ' ') END AS flag
FROM lineitem
"""

SQL["block_messages"] = """
WITH q AS (
  SELECT conv_id, turn, role, concat('"', replace(replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))),
    '"', concat(chr(92), '"')), chr(10), concat(chr(92), 'n')), chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't')), '"') AS t
  FROM conversations)
SELECT conv_id, turn, role,
  CASE WHEN turn % 4 = 1 THEN concat('[{"type":"text","text":', t, '},{"type":"tool_use","id":7,"name":"search"},{"type":"tool_use"}]')
       WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN concat('[{"type":"tool_result","content":[{"text":', t, ',"type":"text"}]}]')
       WHEN turn % 4 = 2 THEN concat('[{"type":"tool_result","content":', t, '},"stray",{"type":"other"}]')
       WHEN turn % 4 = 3 THEN concat('[{"type":"image"},{"type":"text","text":', t, '}]')
       WHEN conv_id % 17 = 5 THEN NULL
       ELSE t END AS content
FROM q
"""
