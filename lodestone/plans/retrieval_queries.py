"""Queries over documents, embeddings and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS
from lodestone.functions.text import tokens
from lodestone.functions.vectors import is_finite, norm
from lodestone.operators import retrieval
from lodestone.operators.chunking import chunk_guard as guard
from lodestone.operators.chunking import chunk_sections
from lodestone.plans.catalog import query, table

#: Every id divisible by this is a query.
QUERY_STEP = 100
#: Copies from which on a text isn't joined by a shuffle.
COMMON = 10_000
#: Neighbours by number of each query.
NEAREST = 20
TARGET, OVERLAP = DEFAULTS.chunk_target_characters, DEFAULTS.chunk_overlap_characters

COSINE = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / nullif(sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])), 0)"
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
POSTINGS = f"posts AS (SELECT doc_id AS chunk_id, unnest({TOKENS.format('text')}) AS term, generate_subscripts({TOKENS.format('text')}, 1) AS pos FROM documents)"


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("document_id"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"""SELECT e.vec_id AS chunk_id, round({COSINE.format(a="e.embedding", b="q.embedding")}, 6) AS similarity,
  row_number() OVER (ORDER BY round({COSINE.format(a="e.embedding", b="q.embedding")}, 6) DESC, e.vec_id)::INTEGER AS rank
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY rank LIMIT 20""")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks nearest to the vector of chunk 0."""
    chunks = embedded(spark, sf_dir)
    first = chunks.filter("chunk_id = 0").first()
    return retrieval.semantic_topk(chunks, first.embedding if first and first.embedding else [])


@query(f"""SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round({COSINE.format(a="e.embedding", b="q.embedding")}, 6) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COSINE.format(a="e.embedding", b="q.embedding")}, 6) DESC, e.vec_id)::INTEGER AS rank
FROM embeddings e, embeddings q WHERE q.vec_id % {QUERY_STEP} = 0) WHERE rank <= 20""")
def semantic_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = embedded(spark, sf_dir)
    wanted = chunks.filter(F.col("chunk_id") % QUERY_STEP == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return retrieval.semantic_topk_batch(chunks, wanted)


@query(f"""WITH {POSTINGS} SELECT chunk_id, term, count(*) AS tf, min(pos)::BIGINT AS first_pos, max(pos)::BIGINT AS last_pos FROM posts GROUP BY ALL""")
def postings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all terms: how often, and from where to where, each chunk has them."""
    posts = retrieval.postings(texts(spark, sf_dir).repartition("chunk_id"))  # texts are shuffled, which are smaller than their postings
    return posts.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"))


def lexical_sql(found: str) -> str:
    """Top 20 of a WITH clause that ends in found(chunk_id, lexical_score)."""
    return f"""WITH {POSTINGS}, {found} SELECT chunk_id, lexical_score, row_number() OVER (ORDER BY lexical_score DESC, chunk_id)::INTEGER AS rank
FROM (SELECT chunk_id, round(lexical_score, 6) AS lexical_score FROM found) ORDER BY rank LIMIT 20"""


def covers_sql(a: str, b: str, name: str = "found") -> str:
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n FROM posts WHERE term IN ('{a}', '{b}')),
{name}_l AS (SELECT *, max(CASE WHEN term = '{a}' THEN pos END) OVER w AS pa, max(CASE WHEN term = '{b}' THEN pos END) OVER w AS pb,
  max(CASE WHEN term = '{a}' THEN n END) OVER w AS na, max(CASE WHEN term = '{b}' THEN n END) OVER w AS nb FROM {name}_n
  WINDOW w AS (PARTITION BY chunk_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
{name}_c AS (SELECT chunk_id, least(pa, pb) AS p, least(na, nb) AS m, min(pos) AS q, min(n) AS k FROM {name}_l WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY 1, 2, 3),
{name} AS (SELECT chunk_id, sum(0.1 / (1 + (q - p) - (k - m))) AS lexical_score FROM {name}_c GROUP BY 1)"""


def lexical(spark: SparkSession, sf_dir: str, search: str) -> DataFrame:
    return retrieval.lexical_topk(texts(spark, sf_dir), search)


@query(lexical_sql(covers_sql("the", "of")))
def lexical_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, "the of")


@query(lexical_sql("found AS (SELECT chunk_id, 0.1::DOUBLE * count(*) AS lexical_score FROM posts WHERE term IN ('der', 'una') GROUP BY 1)"))
def lexical_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, "der or una")


@query(lexical_sql(covers_sql("the", "of", "pair") + ", found AS (SELECT * FROM pair WHERE chunk_id NOT IN (SELECT chunk_id FROM posts WHERE term = 'license'))"))
def lexical_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, "the of -license")


@query(lexical_sql(covers_sql("of", "the", "pair") + ", found AS (SELECT * FROM pair WHERE chunk_id IN (SELECT a.chunk_id FROM posts a JOIN posts b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'))"))
def lexical_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase, by all covers of its words; lexical_phrase_covers ranks by the phrase's own."""
    with_phrase = texts(spark, sf_dir).filter(F.lower("text").rlike(r"(?<![\p{L}\p{N}])of[^\p{L}\p{N}]+the(?![\p{L}\p{N}])"))
    return retrieval.lexical_topk(with_phrase, "of the")


@query(lexical_sql("found AS (SELECT a.chunk_id, 0.1::DOUBLE * count(*) AS lexical_score FROM posts a JOIN posts b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1)"))
def lexical_phrase_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, '"of the"')


def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready chunks with both a text and a vector; a document that is labelled of no quality isn't ready."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("knowledge_base"))
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    vectors = embedded(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id")
    return docs.join(bad, "doc_id", "left_anti").join(vectors, "doc_id").withColumnRenamed("doc_id", "chunk_id")


def hybrid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document asks with its vector and its first two terms of three letters or more."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % QUERY_STEP == 0)
    long_terms = F.slice(F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.char_length(t) >= 3)), 1, 2)
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("source").alias("knowledge_base"), long_terms.alias("terms"))
    return asked.join(embedded(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id")


RANKED_SQL = f"""WITH chunks AS (SELECT d.doc_id AS chunk_id, d.source AS kb, d.text, e.embedding, e.label AS document_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
  WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
words AS (SELECT doc_id, source, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, source, list_filter({TOKENS.format("text")}, lambda t: length(t) >= 3) AS w FROM documents WHERE doc_id % {QUERY_STEP} = 0)),
firsts AS (SELECT doc_id AS query_id, source AS kb, term, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS t FROM words GROUP BY doc_id, source, term QUALIFY t <= 2),
asked AS (SELECT d.doc_id AS query_id, d.source AS kb, e.embedding, (SELECT count(*) FROM firsts f WHERE f.query_id = d.doc_id) AS wanted FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % {QUERY_STEP} = 0),
near AS (SELECT q.query_id, c.chunk_id, round({COSINE.format(a="c.embedding", b="q.embedding")}, 6) AS similarity FROM chunks c JOIN asked q ON q.kb = c.kb),
semantic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM near QUALIFY r <= 20),
posts AS (SELECT chunk_id, kb, unnest({TOKENS.format("text")}) AS term, generate_subscripts({TOKENS.format("text")}, 1) AS pos FROM chunks),
hits AS (SELECT f.query_id, p.chunk_id, a.wanted, f.t, p.pos FROM posts p JOIN firsts f ON f.kb = p.kb AND f.term = p.term JOIN asked a ON a.query_id = f.query_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS n FROM hits),
latest AS (SELECT *, max(CASE WHEN t = 1 THEN pos END) OVER w AS pa, max(CASE WHEN t = 2 THEN pos END) OVER w AS pb, max(CASE WHEN t = 1 THEN n END) OVER w AS na, max(CASE WHEN t = 2 THEN n END) OVER w AS nb
  FROM numbered WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
covers AS (SELECT query_id, chunk_id, CASE WHEN wanted = 2 THEN least(pa, pb) ELSE pa END AS p, CASE WHEN wanted = 2 THEN least(na, nb) ELSE na END AS m, min(pos) AS q, min(n) AS k
  FROM latest WHERE pa IS NOT NULL AND (pb IS NOT NULL OR wanted = 1) GROUP BY 1, 2, 3, 4),
scores AS (SELECT query_id, chunk_id, round(sum(0.1 / (1 + (q - p) - (k - m))), 6) AS lexical_score FROM covers GROUP BY 1, 2),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS r FROM scores QUALIFY r <= 20),
fused AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.chunk_id, l.chunk_id) AS chunk_id, s.similarity, l.lexical_score,
  round(coalesce(1.0::DOUBLE / (60 + s.r), 0) + coalesce(1.0::DOUBLE / (60 + l.r), 0), 8) AS fused_score FROM semantic s FULL JOIN lexical l ON s.query_id = l.query_id AND s.chunk_id = l.chunk_id),
named AS (SELECT f.*, c.document_id FROM fused f JOIN chunks c USING (chunk_id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY fused_score DESC, coalesce(similarity, -2) DESC, coalesce(lexical_score, -1) DESC, chunk_id) AS o FROM named QUALIFY o <= 3),
evidence AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, coalesce(similarity, -2) DESC, coalesce(lexical_score, -1) DESC, chunk_id)::INTEGER AS retrieval_rank FROM capped QUALIFY retrieval_rank <= 8)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve(hybrid_chunks(spark, sf_dir), hybrid_queries(spark, sf_dir))


@query(RANKED_SQL + " SELECT query_id, chunk_id, document_id, similarity, lexical_score, fused_score, retrieval_rank, 'E' || retrieval_rank AS evidence_id FROM evidence")
def hybrid_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every query: semantic and lexical candidates of its knowledge base, fused and capped."""
    return evidence(spark, sf_dir).select("query_id", "chunk_id", "document_id", "similarity", "lexical_score", "fused_score", "retrieval_rank", "evidence_id")


# The same with two embedding models: chunks go by whether their number is odd, queries by that of their hundreds.
MODELS_SQL = RANKED_SQL.replace("d.source AS kb, d.text", "d.source || '/' || (d.doc_id % 2) AS kb, d.text").replace("doc_id AS query_id, source AS kb, term", "doc_id AS query_id, source || '/' || (doc_id // 100 % 2) AS kb, term").replace("d.source AS kb, e.embedding", "d.source || '/' || (d.doc_id // 100 % 2) AS kb, e.embedding")


@query(MODELS_SQL + " SELECT query_id, chunk_id, document_id, similarity, lexical_score, fused_score, retrieval_rank FROM evidence")
def hybrid_evidence_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from the chunks alone that have vectors of the query's own embedding model."""
    model = lambda number: F.concat(F.lit("model-"), F.pmod(number, F.lit(2)).cast("string"))
    chunks = hybrid_chunks(spark, sf_dir).withColumn("embedding_model", model(F.col("chunk_id")))
    asked = hybrid_queries(spark, sf_dir).withColumn("embedding_model", model(F.floor(F.col("query_id") / 100)))
    return retrieval.retrieve(chunks, asked).select("query_id", "chunk_id", "document_id", "similarity", "lexical_score", "fused_score", "retrieval_rank")


@query(RANKED_SQL + """ SELECT query_id, coalesce(bool_or(similarity >= 0.28 OR lexical_score >= 0.01), false) AS sufficient, count(*) AS n_evidence FROM evidence GROUP BY 1""")
def evidence_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sufficiency(evidence(spark, sf_dir))


@query(f"""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round({COSINE.format(a="e.embedding", b="q.embedding")}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % {QUERY_STEP} = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM near QUALIFY r <= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, 1.0::DOUBLE / (1 + abs(e.vec_id - q.vec_id)) AS lexical_score
  FROM embeddings e JOIN embeddings q ON e.label = q.label WHERE q.vec_id % {QUERY_STEP} = 0) QUALIFY r <= 20)
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, similarity, round(lexical_score, 6) AS lexical_score, coalesce(a.r, 0)::INTEGER AS semantic_rank, coalesce(b.r, 0)::INTEGER AS lexical_rank,
  round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 8) AS fused_score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of each query's nearest vectors with those of its label that are nearest by number."""
    chunks = embedded(spark, sf_dir)
    asked = chunks.filter(F.col("chunk_id") % QUERY_STEP == 0)
    near = retrieval.semantic_topk_batch(chunks, asked.select(F.col("chunk_id").alias("query_id"), "embedding"))
    placed = numbered(chunks.filter("document_id IS NOT NULL").select("chunk_id", F.col("document_id").alias("source")))
    asked = placed.filter(F.col("chunk_id") % QUERY_STEP == 0)
    beside = F.explode(F.sequence(F.col("place") - NEAREST, F.col("place") + NEAREST))  # the nearest by number are among so many on either side
    wanted = asked.select(F.col("chunk_id").alias("query_id"), "source", beside.alias("place"))
    same = placed.join(wanted, ["source", "place"])
    apart = same.select("query_id", "chunk_id", (1.0 / (1 + F.abs(F.col("chunk_id") - F.col("query_id")))).alias("lexical_score"))
    fused = retrieval.fuse(near, retrieval.ranked(apart, "lexical_score", NEAREST))
    rank = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fused.select("query_id", "chunk_id", "similarity", F.round("lexical_score", 6).alias("lexical_score"), rank("semantic_rank"), rank("lexical_rank"), "fused_score")


@query(f"""WITH near AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label AS document_id, round({COSINE.format(a="e.embedding", b="q.embedding")}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % {QUERY_STEP} = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM near QUALIFY r <= 20),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(1.0::DOUBLE / (60 + r), 8) DESC, similarity DESC, chunk_id) AS o FROM a QUALIFY o <= 3)
SELECT query_id, chunk_id, document_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + r), 8) DESC, similarity DESC, chunk_id)::INTEGER AS retrieval_rank FROM c QUALIFY retrieval_rank <= 8""")
def per_document_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three chunks of a document, and eight in all, of each query's nearest."""
    chunks = embedded(spark, sf_dir)
    asked = chunks.filter(F.col("chunk_id") % QUERY_STEP == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    near = retrieval.semantic_topk_batch(chunks, asked)
    none = near.select("query_id", "chunk_id", F.lit(0.0).alias("lexical_score"), "rank").filter(F.lit(False))
    fused = retrieval.fuse(near, none).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return retrieval.select_evidence(fused).select("query_id", "chunk_id", "document_id", "similarity", "retrieval_rank")


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CHUNKS_SQL = rf"""WITH RECURSIVE docs AS (SELECT doc_id, trim(text, {WHITE}) AS t FROM documents WHERE trim(text, {WHITE}) <> ''),
cut AS (
  SELECT doc_id, t, 0 AS start, 0 AS stop, 0 AS step FROM docs
  UNION ALL
  SELECT doc_id, t, next_start, CASE WHEN next_start + {TARGET} >= length(t) THEN length(t)
      WHEN tail = {TARGET - TARGET // 2} THEN next_start + {TARGET} ELSE next_start + {TARGET} - tail END, step + 1
  FROM (SELECT *, length(regexp_extract(substr(t, next_start + {TARGET // 2} + 1, {TARGET - TARGET // 2}), '[^ \n]*$')) AS tail FROM (
    SELECT doc_id, t, step, stop, CASE WHEN step = 0 THEN 0 ELSE least(stop, greatest(start + 1, stop - {OVERLAP}) + length(regexp_extract(substr(t, greatest(start + 1, stop - {OVERLAP}) + 1, stop - greatest(start + 1, stop - {OVERLAP})), '^[^\s]*'))) END AS next_start
    FROM cut WHERE step = 0 OR stop < length(t)))
),
chunks AS (SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS part, trim(substr(t, start + 1, stop - start), {WHITE}) AS text FROM cut WHERE step > 0 AND trim(substr(t, start + 1, stop - start), {WHITE}) <> '')"""


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return chunk_sections(docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("section_no"), "text"))


@query(CHUNKS_SQL + " SELECT document_id, part::INTEGER AS part, (part - 1)::INTEGER AS ordinal, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in chunks."""
    chunks = document_chunks(spark, sf_dir)
    return chunks.select("document_id", "part", "ordinal", F.char_length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(CHUNKS_SQL + " SELECT document_id, count(*) AS n_chunks, max(length(text))::INTEGER AS longest FROM chunks GROUP BY 1")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.max(F.char_length("text")).alias("longest"))


@query(CHUNKS_SQL + """ SELECT d.doc_id AS document_id, coalesce(n, 0) AS n_chunks, CASE WHEN coalesce(n, 0) = 0 OR n > 5000 THEN 'failed' ELSE 'ready' END AS status,
  CASE WHEN coalesce(n, 0) = 0 THEN 'No readable text was found' WHEN n > 5000 THEN 'The document has too many chunks' END AS safe_error
FROM documents d LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) ON document_id = d.doc_id""")
def chunk_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without chunks or with too many fail."""
    return guard(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")), document_chunks(spark, sf_dir))


@query(CHUNKS_SQL + """, pairs AS (SELECT *, lag(text) OVER (PARTITION BY document_id ORDER BY part) AS previous FROM chunks)
SELECT document_id, count(*) AS n_pairs, sum((length(text) <= 800)::BIGINT)::BIGINT AS n_short, sum((contains(previous, regexp_extract(text, '^\\S+')))::BIGINT)::BIGINT AS n_joined FROM pairs WHERE previous IS NOT NULL GROUP BY 1""")
def chunk_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks keep to the length, and begin with a word that the chunk before also has."""
    order = Window.partitionBy("document_id").orderBy("ordinal")
    pairs = document_chunks(spark, sf_dir).withColumn("previous", F.lag("text").over(order)).filter("previous IS NOT NULL")
    first = F.regexp_extract("text", r"^\S+", 0)
    return pairs.groupBy("document_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.char_length("text") <= TARGET).alias("n_short"), F.count_if(F.contains("previous", first)).alias("n_joined"))


@query("""WITH v AS (SELECT vec_id, label, embedding, list_aggregate(list_transform(embedding, lambda x: isfinite(x)), 'bool_and') AS finite, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length FROM embeddings)
SELECT vec_id AS chunk_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'dimension' WHEN NOT finite THEN 'not finite' WHEN length = 0 THEN 'zero' ELSE 'valid' END AS verdict, round(length, 4) AS length FROM v""")
def embedding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a vector from being stored, if anything."""
    e = F.col("embedding")
    verdict = F.when(e.isNull(), "missing").when(F.size(e) != 64, "dimension").when(~is_finite(e), "not finite").when(norm(e) == 0, "zero").otherwise("valid")
    return embedded(spark, sf_dir).select("chunk_id", verdict.alias("verdict"), F.round(norm(e), 4).alias("length"))


@query("SELECT doc_id AS chunk_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 8)::INTEGER AS place FROM documents")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request that each text goes into, and its place there: eight of a knowledge base together, in order."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    n = F.col("place")
    return numbered(docs).select("chunk_id", F.floor(n / DEFAULTS.embedding_batch_size).cast("long").alias("batch"), "source", (n % DEFAULTS.embedding_batch_size).cast("int").alias("place"))


def numbered(chunks: DataFrame, block_bits: int = 12) -> DataFrame:
    """chunks (chunk_id, source) with place, from 0 in the order of chunk_id in each source. They are numbered in blocks of
    2 ** block_bits ids, after which the rows of the source's earlier blocks are added, so that no task takes a whole
    source."""
    rows = chunks.withColumn("_block", F.shiftright("chunk_id", block_bits))
    counts = rows.groupBy("source", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = counts.select(F.col("source").alias("_source"), F.col("_block").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy("source", "_block").orderBy("chunk_id")) - 1)
    joined = inside.join(starts, F.col("source").eqNullSafe(F.col("_source")) & F.col("_block").eqNullSafe(F.col("_of")))
    return joined.select("chunk_id", "source", (F.col("_start") + F.col("_in")).alias("place"))


@query(f"""SELECT source AS knowledge_base, sha256(text) AS sha256, count(*) AS n_documents, min(doc_id) AS first_document FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a knowledge base has more than once."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    by = docs.groupBy(F.col("source").alias("knowledge_base"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return by.agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document")).filter("n_documents > 1")


@query("""SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size_bytes, count(*) OVER (PARTITION BY sha256(text)) AS n_copies, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS is_first FROM documents""")
def doc_fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document, its size, how many share it, and whether it is the first of them."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", digest.alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))
    docs = docs.withColumn("_key", F.coalesce("sha256", F.lit("")))
    copies = docs.groupBy("_key").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("_first"))
    common = copies.filter(F.col("n_copies") > COMMON)  # at most a row for each COMMON documents; their documents stay where they are
    rare = docs.join(F.broadcast(common.select("_key")), "_key", "left_anti").join(copies, "_key")
    joined = rare.unionByName(docs.join(F.broadcast(common), "_key"))
    return joined.select("doc_id", "sha256", "size_bytes", "n_copies", (F.col("doc_id") == F.col("_first")).alias("is_first"))


