"""Passages and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from ..operators import retrieval as rt
from ..registry import operation
from ..session import spread
from ..sources import files
from ..sources.tables import fixture, table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages with numeric ids: ties in a ranking go to the smaller id."""
    return fixture(spark, sf, "passages").withColumn("id", F.col("id").cast("bigint"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text, with the vector of the same number, if there is one, as its embedding."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return texts.join(vectors, "query_id", "left")


# --- chunks ----------------------------------------------------------------------------------------------

_WORDS = "[x for x in regexp_split_to_array(text, '\\s+') if x <> '']"


@operation("TXT-1", sql=f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, len(ws), 448)) AS start FROM w)
SELECT doc_id, CAST(start // 448 + 1 AS BIGINT) AS chunk_no, CAST(ceil(len(ws) / 448.0) AS BIGINT) AS n_chunks,
  array_to_string(ws[start + 1 : start + 512], ' ') AS chunk FROM c""")
def word_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in chunks of 512 words that overlap by 64."""
    return ck.explode_chunks(_documents(spark, sf), ck.word_chunks(F.col("text")), "doc_id")


@operation("TXT-2", sql="""
WITH c AS (SELECT doc_id, text, greatest(length(text) - 200, 1) AS last_start FROM documents),
s AS (SELECT doc_id, text, last_start, unnest(range(1, last_start + 1, 1800)) AS start FROM c)
SELECT doc_id, CAST((start - 1) // 1800 + 1 AS BIGINT) AS chunk_no, CAST((last_start - 1) // 1800 + 1 AS BIGINT) AS n_chunks,
  substr(text, start, 2000) AS chunk FROM s""")
def char_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in chunks of 2000 characters that overlap by 200."""
    return ck.explode_chunks(_documents(spark, sf), ck.char_chunks(F.col("text")), "doc_id")


@operation("TXT-3", sql="""
WITH s AS (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 4096)) AS start FROM documents)
SELECT doc_id, CAST((start - 1) // 4096 + 1 AS BIGINT) AS part_no, substr(text, start, 4096) AS part FROM s""")
def message_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in consecutive parts of at most 4096 characters."""
    parts = ck.explode_chunks(_documents(spark, sf), ck.message_parts(F.col("text")), "doc_id")
    return parts.select("doc_id", F.col("chunk_no").alias("part_no"), F.col("chunk").alias("part"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@operation("TXT-4", sql=f"""
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM
  (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often every token occurs, and in how many documents."""
    return rt.token_statistics(rt.tokenized(_docs(spark, sf)))


@operation("TXT-5", sql="""
SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS label FROM documents""")
def passage_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Short labels of the documents."""
    return _documents(spark, sf).select("doc_id", tx.label(F.col("text")).alias("label"))


# --- ranking ------------------------------------------------------------------------------------------------

_VECTORS = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = "round(list_cosine_similarity(a.v, b.v), 6)"


def _dense(queries: str, n: int) -> str:
    return (f"SELECT * FROM (SELECT a.id AS query_id, b.id AS id, {_COS} AS similarity, row_number() OVER "
            f"(PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS rank FROM {queries} a, p b) WHERE rank <= {n}")


def _bm25(docs: str, n: int) -> str:
    """Ranked (query_id, id, score, rank) of `questions` over a relation (id, text)."""
    return f"""
t AS (SELECT id, {_TOKENS} AS ts FROM {docs}),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM t) GROUP BY 1, 2),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS mean_len FROM t),
raw AS (SELECT term, ln(stats.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, stats GROUP BY term, stats.n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT favg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS n_asked FROM
   (SELECT query_id, unnest({_TOKENS}) AS term FROM questions) GROUP BY 1, 2),
scored AS (SELECT query_id, tf.id, round(sum(n_asked * idf * tf * 2.5 /
     (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean_len))), 6) AS score
   FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN t ON t.id = tf.id, stats GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
   FROM scored WHERE score > 0) WHERE rank <= {n})"""


_ALL_DOCS = "WITH questions AS (SELECT item_id AS query_id, text FROM benchmark),"


@operation("RET-1 JOIN-7", sql=f"WITH {_VECTORS} " + _dense("p", 5))
def dense_top(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest vectors of every vector by cosine."""
    vectors = table(spark, sf, "embeddings")
    return rt.dense_top(vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
                        vectors.select(F.col("vec_id").alias("id"), "embedding"), 5)


@operation("RET-1 JOIN-7", sql=f"WITH {_VECTORS} " + _dense("p", 5))
def dense_top_by_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same nearest vectors through pruned cells, the way taken when both sides are large."""
    vectors = table(spark, sf, "embeddings")
    return rt.dense_top(vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
                        vectors.select(F.col("vec_id").alias("id"), "embedding"), 5, broadcast_components=0)


@operation("RET-2", sql=_ALL_DOCS + " docs AS (SELECT doc_id AS id, text FROM documents),"
           + _bm25("docs", 10) + " SELECT query_id, id, score FROM scored")
def keyword_scores(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 score of every document sharing a word with a benchmark text."""
    return rt.keyword_scores(_asked(spark, sf), _docs(spark, sf))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select(F.col("doc_id").alias("id"), "text")


@operation("RET-3", sql=_ALL_DOCS + " docs AS (SELECT doc_id AS id, text FROM documents),"
           + _bm25("docs", 10) + " SELECT * FROM bm25")
def keyword_top(spark: SparkSession, sf: str) -> DataFrame:
    """Ten best documents per benchmark text by BM25."""
    return rt.keyword_top(_asked(spark, sf), _docs(spark, sf), 10)


_HYBRID = f"""
WITH questions AS (SELECT item_id AS query_id, text FROM benchmark),
passages AS (SELECT doc_id AS id, text, source FROM documents),
p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
asked_vectors AS (SELECT item_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON item_id = vec_id),
dense AS ({_dense('asked_vectors', 3)}),
{_bm25('passages', 3)},
fused AS (SELECT query_id, id, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + x.rank), 0) AS fused,
   d.rank AS dense_rank, x.rank AS lexical_rank, similarity FROM dense d FULL JOIN bm25 x USING (query_id, id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank NULLS LAST,
   lexical_rank NULLS LAST) AS rank FROM fused),
hits AS (SELECT query_id, rank, id, CASE WHEN query_id IN (SELECT query_id FROM bm25) THEN round(fused, 6)
   ELSE round(similarity, 4) END AS score, round(similarity, 4) AS similarity FROM ranked WHERE rank <= 3)
"""


@operation("RET-4", sql=_HYBRID + """
SELECT query_id, id, round(fused, 6) AS fused, dense_rank, lexical_rank, rank FROM ranked""")
def fused_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Dense and keyword lists of every question fused by reciprocal ranks."""
    questions, passages = _questions(spark, sf), _passages(spark, sf)
    fused = rt.fuse(*rt.ranked_lists(questions, passages, 3))
    return fused.withColumn("fused", F.round("fused", 6))


@operation("RET-5", sql=_HYBRID + "SELECT query_id, rank, hits.id, score, similarity, source, passages.text "
                                  "FROM hits JOIN passages ON hits.id = passages.id")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Three best passages per question by fused ranking, with text and source."""
    passages = _passages(spark, sf)
    return rt.hybrid_top(_questions(spark, sf), passages).join(passages.select("id", "text", "source"), "id")


@operation("RET-6", sql=_HYBRID + """
SELECT query_id, 'c' || CAST(rank AS varchar) AS citation, id, score,
  coalesce(max(similarity) OVER (PARTITION BY query_id), 0) < 0.4 AS low_confidence FROM hits""")
def cited_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with citation ids and the confidence gate on the cosine."""
    hits = rt.hybrid_top(_questions(spark, sf), _passages(spark, sf))
    return rt.cite(hits).select("query_id", "citation", "id", "score", "low_confidence")


@operation("RET-6", sql=_HYBRID + """
SELECT query_id, 'c' || CAST(rank AS varchar) AS citation, id, score,
  max(score) OVER (PARTITION BY query_id) < 0.4 AS low_confidence FROM hits""")
def cited_hits_by_fused_score(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with the confidence gate on the fused score."""
    hits = rt.hybrid_top(_questions(spark, sf), _passages(spark, sf))
    return rt.cite(hits, by="score").select("query_id", "citation", "id", "score", "low_confidence")


_EDGES = f"""
WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON doc_id = vec_id),
near AS (SELECT a.id AS x, b.id AS y, {_COS} AS s, row_number() OVER (PARTITION BY a.id ORDER BY {_COS} DESC, b.id) AS rank
  FROM p a, p b WHERE a.id <> b.id AND {_COS} >= 0.35)
SELECT least(x, y) AS source, greatest(x, y) AS target, round(max(s), 3) AS weight FROM near WHERE rank <= 3 GROUP BY 1, 2
"""


@operation("RET-7 JOIN-7", sql=_EDGES)
def similarity_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected edges between each passage and its three nearest others."""
    return rt.graph_edges(_passages(spark, sf))


@operation("RET-7", sql="""
SELECT doc_id AS id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS label, source
FROM documents""")
def similarity_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the similarity graph."""
    return rt.graph_nodes(_passages(spark, sf))


@operation("RET-8", sql="""
SELECT vec_id, round(sqrt(list_sum([x * x for x in u])), 6) AS length, round(u[1], 6) AS first_component FROM
(SELECT vec_id, [x / n for x in v] AS u FROM
  (SELECT vec_id, v, sqrt(list_sum([x * x for x in v])) AS n FROM
    (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)))""")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Length and first component of the vectors scaled to length one."""
    unit = table(spark, sf, "embeddings").select("vec_id", rt.unit_vector(F.col("embedding")).alias("u"))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x))
    return unit.select("vec_id", F.round(length, 6).alias("length"), F.round(F.col("u")[0], 6).alias("first_component"))


@operation("SNK-4", sql="""
SELECT CAST(doc_id AS varchar) AS id, text, source FROM documents ORDER BY CAST(doc_id AS varchar) LIMIT 1000""")
def listed_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The first thousand passages of the store by id."""
    store = _documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text", "source")
    return files.list_passages(store)


@operation("SNK-4", sql="SELECT count(*) AS n FROM documents")
def passage_count(spark: SparkSession, sf: str) -> DataFrame:
    """Number of passages in the store."""
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))
