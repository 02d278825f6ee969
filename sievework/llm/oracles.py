"""DuckDB SQL for the answers that SQL can state."""

from __future__ import annotations

from . import op4_secrets

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT doc_id, p, array_to_string(ws[p : p + 49], ' ') AS s FROM
  (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w)),
first AS (SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM windows JOIN first USING (s) WHERE first_doc < doc_id),
said AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM said ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 3], ' ') AS t FROM
  (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS node, doc_id AS found FROM documents UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.found)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT node, min(found) AS component_id FROM reach GROUP BY 1) r ON r.node = documents.doc_id
"""

_PLAIN = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '')"

CONTAMINATED = f"""
WITH i AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
s AS (SELECT DISTINCT item_id, k, array_to_string(ws[p : p + k - 1], ' ') AS t FROM
  (SELECT item_id, ws, least(5, len(ws)) AS k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY 1),
d AS (SELECT DISTINCT doc_id, k, array_to_string(ws[p : p + k - 1], ' ') AS t FROM
  (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS p FROM (SELECT doc_id, {_PLAIN} AS ws FROM documents), (SELECT DISTINCT k FROM s)))
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN s USING (k, t) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""


def _caseless(pattern: str) -> str:
    """The pattern with its small letters in either case, outside of character classes."""
    out, inside = "", False
    for k, c in enumerate(pattern):
        inside = c == "[" or inside and c != "]"
        escaped = k > 0 and (pattern[k - 1] == "\\" or pattern[k - 3:k] == "\\x2")
        out += f"[{c}{c.upper()}]" if c.isalpha() and not inside and not escaped else c
    return out


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: positions are lengths of what stands between the matches and of the matches."""
    if pattern.startswith("(?i)"):
        pattern = _caseless(pattern[4:])
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, source, text, '{kind}' AS kind, {rank} AS rank, secret[i] AS secret,
  list_sum(list_transform(between[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) AS start,
  length(found[i]) AS n FROM (SELECT doc_id, source, text, regexp_extract_all(text, {p}) AS found, regexp_extract_all(text, {p}, {group}) AS secret,
    string_split_regex(text, {p}) AS between, unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS i FROM documents) WHERE length(secret[i]) >= {least}"""


# runs have the same matches of the length that counts whether shorter ones are found and dropped or not
_LONG = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
_BASE = " UNION ALL ".join(_found(i, kind, _LONG.get(kind, pattern), group, least)
                           for i, (kind, pattern, group, least) in enumerate(op4_secrets.KINDS))
_JOINED = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank)"

SECRETS = f"""
WITH base AS ({_BASE}),
generic AS (SELECT g.* FROM ({_found(len(op4_secrets.KINDS), *op4_secrets.GENERIC)}) g ANTI JOIN base b
  ON b.doc_id = g.doc_id AND b.start < g.start + g.n AND g.start < b.start + b.n
  WHERE regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]')),
every AS (SELECT * FROM base UNION ALL SELECT * FROM generic),
owners AS (SELECT secret, count(DISTINCT coalesce('=' || source, '')) < {op4_secrets.COPIED_OWNERS}
  AND count(DISTINCT text) < {op4_secrets.COPIED_REPOSITORIES} AS live FROM every GROUP BY 1),
judged AS (SELECT every.*, live FROM every JOIN owners USING (secret) WHERE kind <> 'generic' OR live),
told AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, {_JOINED} FILTER (WHERE kind <> 'generic') AS base, {_JOINED} AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN told USING (doc_id)
"""


def _centroids(rounds: int = 10) -> str:
    """Every round is two tables: the vectors' nearest centroids and the centroids' next places."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, row, x, best.k AS k, best.d AS d FROM
  (SELECT vec_id, row, v.x AS x, min({{'d': CAST({distance} AS BIGINT), 'k': k}}) AS best FROM v, c{k} c GROUP BY vec_id, row, v.x))""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT k, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS x FROM
  (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, unnest(range(64)) AS i FROM a{k}) GROUP BY k, i) GROUP BY k),
c{k + 1} AS MATERIALIZED (SELECT k, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (k))""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(CAST(embedding AS DOUBLE[]), lambda e: CAST(floor(1024 * e) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT k - 1 AS k, x FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id), x) AS k FROM v) WHERE k <= 8),
{", ".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k
"""


CENTROIDS = _centroids()

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
said AS (SELECT row, lang, source, unnest(ts) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM said GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, k.term, coalesce(counts.c, 0) AS c, k.c AS lang_c FROM groups g JOIN kept k USING (lang)
  LEFT JOIN counts ON counts.lang = g.lang AND counts.source = g.source AND counts.term = k.term),
shares AS MATERIALIZED (SELECT lang, source, term, c, 1 + (1000000000 * CAST(c + 1 AS HUGEINT)) // (sum(c) OVER g + count(*) OVER g) AS p,
  1 + (1000000000 * CAST(lang_c + 1 AS HUGEINT)) // (sum(lang_c) OVER g + count(*) OVER g) AS q FROM every WINDOW g AS (PARTITION BY lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN summed USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM shares WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
WHERE part = 'pair' OR rank <= 200
"""
