"""Queries over stored postings: batches of searches, whole trees, and evidence from both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import cells, retrieval, search
from lodestone.plans.catalog import ORACLES, query, table
from lodestone.plans.retrieval_queries import POSTINGS, QUERY_STEP, RANKED_SQL, TOKENS, embedded, hybrid_chunks, texts
from lodestone.session import new_path

BUCKETS = 64
MOST_TERMS = 10


def asked_terms(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Every hundredth document asks, within its source, for as many of its first terms of three letters or more as its
    number says: from `least` to ten."""
    docs = table(spark, sf_dir, "documents").filter(F.col("doc_id") % QUERY_STEP == 0)
    many = F.floor(F.col("doc_id") / QUERY_STEP) % (MOST_TERMS + 1 - least) + least
    found = F.slice(F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.char_length(t) >= 3)), F.lit(1), many.cast("int"))
    return docs.select(F.col("doc_id").alias("query_id"), F.col("source").alias("knowledge_base"), found.alias("terms"))


def firsts_sql(least: int) -> str:
    return f"""words AS (SELECT doc_id, source, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, source, list_filter({TOKENS.format("text")}, lambda t: length(t) >= 3) AS w FROM documents WHERE doc_id % {QUERY_STEP} = 0)),
firsts AS (SELECT doc_id AS query_id, source AS kb, term, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS t FROM words GROUP BY doc_id, source, term QUALIFY t <= (doc_id // {QUERY_STEP}) % {MOST_TERMS + 1 - least} + {least})"""


_NEXT = [f"p{t}" for t in range(1, MOST_TERMS + 1)]
#: From hits(query_id, chunk_id, wanted, t, pos) to scores(query_id, chunk_id, lexical_score), for up to ten terms.
SCORES_SQL = f"""nexts AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS n, {", ".join(f"min(CASE WHEN t = {t} THEN pos END) OVER w AS p{t}" for t in range(1, MOST_TERMS + 1))} FROM hits
  WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ends AS (SELECT *, CASE WHEN {" + ".join(f"({p} IS NOT NULL)::INTEGER" for p in _NEXT)} = wanted THEN greatest({", ".join(_NEXT)}) END AS f FROM nexts),
covers AS (SELECT * FROM (SELECT *, lead(f) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS g FROM ends) WHERE f IS NOT NULL AND (g IS NULL OR g > f)),
scores AS (SELECT c.query_id, c.chunk_id, round(sum(0.1 / (1 + (c.f - c.pos) - (e.n - c.n))), 6) AS lexical_score FROM covers c JOIN nexts e ON e.query_id = c.query_id AND e.chunk_id = c.chunk_id AND e.pos = c.f GROUP BY 1, 2)"""


@query(f"""WITH {POSTINGS}, {firsts_sql(1)},
hits AS (SELECT f.query_id, p.chunk_id, (SELECT count(*) FROM firsts g WHERE g.query_id = f.query_id) AS wanted, f.t, p.pos FROM posts p JOIN documents d ON d.doc_id = p.chunk_id JOIN firsts f ON f.kb = d.source AND f.term = p.term),
{SCORES_SQL} SELECT query_id, chunk_id, lexical_score, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id)::INTEGER AS rank FROM scores QUALIFY rank <= 20""")
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of each query's source for one to ten terms, from stored postings."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("knowledge_base"), "text")
    stored = search.store_postings(docs, new_path(spark, "postings"), BUCKETS, ["knowledge_base"])
    asked = asked_terms(spark, sf_dir).select("query_id", "knowledge_base", search.all_of(F.col("terms")).alias("ways"))
    return search.search_stored(stored, asked, 20, ["knowledge_base"], BUCKETS)


#: Searches, and for SQL the parts (one or more words each) and the excluded words of their alternatives.
TREES = (
    ('"of the" or und der -license', ((("of", "the"),), ()), ((("und",), ("der",)), ("license",))),
    ("the of -license or que", ((("the",), ("of",)), ("license",)), ((("que",),), ())),
    ('"the of" "of the" or "de la" les', ((("the", "of"), ("of", "the")), ()), ((("de", "la"), ("les",)), ())),
    ("der die das ist", ((("der",), ("die",), ("das",), ("ist",)), ())),
)


def tree_sql(number: int, ways: tuple) -> str:
    """Scores of one tree: where the next occurrence of each part ends, from each of its words on; what is a least stretch."""
    words = sorted({w for parts, _ in ways for p in parts for w in p})
    parts = [p for some, _ in ways for p in some]
    found = [f"min(CASE WHEN {' AND '.join([f"term = '{p[0]}'", *(f"n{i} = '{w}'" for i, w in enumerate(p[1:], 1))])} THEN pos + {len(p) - 1} END) OVER w AS e{k}" for k, p in enumerate(parts)]
    ends, k = [], 0
    for some, excluded in ways:
        own = [f"e{k + i}" for i in range(len(some))]
        k += len(some)
        held = [f"{e} IS NOT NULL" for e in own] + [f"chunk_id NOT IN (SELECT chunk_id FROM posts WHERE term = '{w}')" for w in excluded]
        ends.append(f"CASE WHEN {' AND '.join(held)} THEN greatest({', '.join(own)}) END")
    among = ", ".join(f"'{w}'" for w in words)
    return f"""t{number}_h AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n, {", ".join(found)} FROM led WHERE term IN ({among})
  WINDOW w AS (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t{number}_f AS (SELECT *, least({", ".join([*ends, "NULL"])}) AS f FROM t{number}_h),
t{number}_c AS (SELECT * FROM (SELECT *, lead(f) OVER (PARTITION BY chunk_id ORDER BY pos) AS g FROM t{number}_f) WHERE f IS NOT NULL AND (g IS NULL OR g > f)),
t{number} AS (SELECT {number}::BIGINT AS query_id, c.chunk_id, round(sum(0.1 / (1 + (c.f - c.pos) - (e.n - c.n))), 6) AS lexical_score FROM t{number}_c c JOIN t{number}_h e ON e.chunk_id = c.chunk_id AND e.pos = c.f GROUP BY 2)"""


_TREES_SQL = ", ".join(tree_sql(k, ways) for k, (_, *ways) in enumerate(TREES))
_BEST_SQL = "row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id)::INTEGER AS rank"


@query(f"""WITH {POSTINGS}, led AS (SELECT *, lead(term) OVER (PARTITION BY chunk_id ORDER BY pos) AS n1 FROM posts), {_TREES_SQL}
SELECT query_id, chunk_id, lexical_score, {_BEST_SQL} FROM ({" UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(len(TREES)))}) QUALIFY rank <= 20""")
def stored_search_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches with alternatives, phrases and exclusions, all at once over stored postings."""
    stored = search.store_postings(texts(spark, sf_dir), new_path(spark, "postings"), BUCKETS)
    asked = spark.createDataFrame([(k, text) for k, (text, *_) in enumerate(TREES)], "query_id long, search string")
    return search.search_stored(stored, search.parsed(asked), 20, buckets=BUCKETS)


@query(f"""WITH {POSTINGS}, led AS (SELECT *, lead(term) OVER (PARTITION BY chunk_id ORDER BY pos) AS n1 FROM posts), {tree_sql(0, TREES[0][1:])}
SELECT chunk_id, lexical_score, {_BEST_SQL} FROM t0 QUALIFY rank <= 20""")
def lexical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search with a phrase, an alternative and an exclusion over the texts themselves."""
    return retrieval.lexical_topk(texts(spark, sf_dir), TREES[0][0])


_PARTS = RANKED_SQL.split("words AS (")[0], RANKED_SQL[RANKED_SQL.index("asked AS (") : RANKED_SQL.index("numbered AS (")], RANKED_SQL[RANKED_SQL.index("lexical AS (") :]


@query(f"""{_PARTS[0]}{firsts_sql(3)}, {_PARTS[1]}{SCORES_SQL}, {_PARTS[2]} SELECT query_id, chunk_id, document_id, similarity, lexical_score, fused_score, retrieval_rank, 'E' || retrieval_rank AS evidence_id FROM evidence""")
def hybrid_evidence_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every query for three to ten terms, with the lexical half from stored postings."""
    chunks = hybrid_chunks(spark, sf_dir)
    vectors = embedded(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "embedding")
    asked = asked_terms(spark, sf_dir, 3).join(vectors, "query_id")
    stored = search.store_postings(chunks, new_path(spark, "postings"), BUCKETS, ["knowledge_base"])
    found = retrieval.retrieve(chunks, asked, stored=stored, buckets=BUCKETS)
    return found.select("query_id", "chunk_id", "document_id", "similarity", "lexical_score", "fused_score", "retrieval_rank", "evidence_id")


@query(ORACLES["semantic_topk_batch"])
def semantic_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth one, from stored cells."""
    chunks, path = embedded(spark, sf_dir), new_path(spark, "cells")
    cells.store_cells(chunks, path)
    asked = chunks.filter(F.col("chunk_id") % QUERY_STEP == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return cells.search_cells(spark, path, asked).select("query_id", "chunk_id", "similarity", "rank")
