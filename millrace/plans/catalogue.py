"""The engine's queries over the star schema and text tables, by name, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import code, identity, text, vector
from millrace.operators import chunk, evaluate, filters, index, knowledge, leakage, matrix, prep, prompt, records, retrieve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# White space as the engine's regular expressions see it, for DuckDB.
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def word_list(x: str) -> str:
    return f"[w FOR w IN regexp_split_to_array({x}, '{WS}+') IF w <> '']"


# -- projections and text ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm('text')} AS clean, sha256({norm('text')}) AS clean_hash FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.normalize_text("text").alias("clean"), text.content_identity("text").alias("clean_hash"))


@query(f"""SELECT doc_id, length(text) AS chars, len({word_list('text')}) AS words,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, substring(text, 1, 40) AS head FROM documents""")
def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return t.select("doc_id", F.length("text").cast("long").alias("chars"), text.token_count("text").cast("long").alias("words"), text.estimated_tokens("text").cast("long").alias("tokens"), text.truncate_tokens("text", 10).alias("head"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS content_hash FROM documents""")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.content_hash("text").alias("content_hash"))


@query()
def code_lexical_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.java_hash("html").alias("code_hash"), F.length(text.java_fingerprint("html")).cast("long").alias("length"))


@query("""SELECT doc_id, sha256(lower(trim(coalesce(source, ''))) || '|' || lower(trim(coalesce(lang, ''))) || '|' || doc_id) AS pair_id,
  lower(trim(source)) || '|' || lower(trim(lang)) AS canonical FROM documents""")
def case_identity(spark: SparkSession, d: str) -> DataFrame:
    key = text.canonical_key("source", "lang")
    return read(spark, d, "documents").select("doc_id", text.joined_hash(key, F.col("doc_id")).alias("pair_id"), key.alias("canonical"))


@query(r"""SELECT doc_id, regexp_replace(text, '(?i)(api[_-]?key|authorization|bearer|token|secret|password)(\s*[:=]\s*)([^\s,;]+)', '\1\2[REDACTED]', 'g') AS redacted FROM documents""")
def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.redact("text").alias("redacted"))


@query(f"""SELECT doc_id, coalesce(nullif({norm('NULL')}, ''), nullif({norm('text')}, ''), '') AS input, lang AS output, 'testing' AS domain
FROM documents WHERE {norm('text')} <> '' AND lang <> ''""")
def instruction_records(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("focal_method"), F.col("text").alias("code"), F.col("lang").alias("test_code"))
    return prep.instruction_records(t, "testing", "Write a test.", ["doc_id"]).drop("instruction")


@query("""SELECT doc_id, CASE WHEN length(text) > 500 THEN rtrim(substring(text, 1, 497)) || '...' ELSE text END AS preview,
  regexp_replace(regexp_replace(source || ' ' || lang, '[^a-zA-Z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents""")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.preview("text").alias("preview"), text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"))


@query("""SELECT doc_id, 'Task: test generation' || chr(10) || chr(10) || 'Java class: ' || source || chr(10) || chr(10) || 'Production Java code:' || chr(10) || lang AS retrieval_query FROM documents""")
def retrieval_queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.retrieval_query("testing", "lang", class_name="source").alias("retrieval_query"))


@query()
def semantic_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return t.select("doc_id", F.array_join(F.array_sort(text.semantic_tokens("text")), " ").alias("tokens"))


# -- filters ----------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, length({strip('text')}) AS chars FROM documents
WHERE length({strip('text')}) BETWEEN 50 AND 4000 AND n_chars > 0 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 20""")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").where("n_chars > 0").where(filters.length_between("text", 50, 4000) & filters.usable_page("text", 20))
    return t.select("doc_id", F.length(text.strip("text")).cast("long").alias("chars"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src0'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(filters.metadata_predicate({"source": "src0"}, ["de", "fr"], "lang")).select("doc_id", "lang", "source")


@query(f"""WITH v AS (SELECT doc_id, sum(CASE WHEN length({strip('text')}) BETWEEN 50 AND 1500 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) AS c,
  length({strip('text')}) BETWEEN 50 AND 1500 AS ok FROM documents) SELECT doc_id FROM v WHERE ok AND c <= 25""")
def limit_valid_in_order(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return prep.first_valid(t, filters.length_between("text", 50, 1500), "doc_id", 25)[0].select("doc_id")


# -- vectors ----------------------------------------------------------------------------------------------------

_TOP = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0{extra}),
s AS (SELECT query_id, vec_id AS document_id, {by}round({score}, 9) AS score FROM embeddings, q {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id{part} ORDER BY score {order}, document_id) AS rank FROM s)
SELECT query_id, document_id, {by_out}round(score, 6) AS score, rank::BIGINT AS rank FROM r WHERE rank <= 5"""
_COS = "list_dot_product(embedding::DOUBLE[], qe) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qe, qe)))"
_L2 = "list_distance(embedding::DOUBLE[], qe)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.withColumnRenamed("vec_id", "document_id")


def _shown(df: DataFrame, *by: str) -> DataFrame:
    return df.select("query_id", "document_id", *by, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_TOP.format(extra="", by="", score=_COS, where="", part="", order="DESC", by_out=""))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query, against all rows."""
    q, docs = _vectors(spark, d)
    return _shown(retrieve.top_k(q, docs, 5))


@query(_TOP.format(extra="", by="", score=_COS, where="WHERE label IN (1, 3, 5)", part="", order="DESC", by_out=""))
def metadata_filter_topk(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _vectors(spark, d)
    return _shown(retrieve.top_k(q, docs.where(F.col("label").isin(1, 3, 5)), 5))


@query(_TOP.format(extra="", by="", score=_L2, where="", part="", order="ASC", by_out=""))
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _vectors(spark, d)
    return _shown(retrieve.top_k(q, docs, 5, score="l2"))


@query(_TOP.format(extra="", by="label, ", score=_COS, where="", part=", label", order="DESC", by_out="label, "))
def collection_topk(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _vectors(spark, d)
    return _shown(retrieve.top_k(q, docs, 5, by=["label"]), "label")


@query("""SELECT vec_id, label, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::BIGINT AS dim,
  len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AS valid,
  len(embedding) = 64 AND len([x FOR x IN [CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 'nan'::FLOAT WHEN vec_id % 3 = 0 THEN 'inf'::FLOAT ELSE 1 END] IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AS valid_spoiled FROM embeddings""")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norms, and whether vectors are whole, also with a component replaced by null, NaN or infinity in some of them."""
    e = read(spark, d, "embeddings")
    bad = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).when(F.col("vec_id") % 5 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 3 == 0, F.lit(float("inf"))).otherwise(1.0).cast("float")
    spoiled = F.concat(F.slice("embedding", 1, 63), F.array(bad))
    return e.select("vec_id", "label", F.round(vector.norm("embedding"), 6).alias("norm"), F.size("embedding").cast("long").alias("dim"), vector.valid("embedding", 64).alias("valid"), vector.valid(spoiled, 64).alias("valid_spoiled"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) AS tok FROM documents),
h AS (SELECT doc_id, sha256(tok) AS h FROM t)
SELECT doc_id, CAST((('0x' || substr(h, 1, 8))::BIGINT) % 64 AS INTEGER) AS idx, sum(CASE WHEN ('0x' || substr(h, 10, 1))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS weight
FROM h GROUP BY 1, 2""")
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return vector.hashed_weights(read(spark, d, "documents"), "doc_id", "text")


_FUSED = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS document_id, label, round({cos}, 9) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, document_id) AS rank FROM s),
f AS (SELECT query_id, document_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf_score, max(score) AS best FROM r WHERE rank <= 5 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, best DESC, document_id) AS final_rank FROM f)
SELECT query_id, document_id, rrf_score, final_rank::BIGINT AS final_rank FROM o WHERE final_rank <= 10""".format(cos=_COS)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _vectors(spark, d)
    return retrieve.fuse_disjoint(retrieve.top_k(q, docs, 5, by=["label"]).withColumnRenamed("label", "collection")).where("final_rank <= 10")


@query(_FUSED)
def rrf_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "document_id", "rrf_score", F.col("final_rank").cast("long").alias("final_rank"))


@query()
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fusion with transitive de-duplication: copies of a text in several collections are one item."""
    q, docs = _vectors(spark, d)
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), text.content_identity("text").alias("identity"))
    hits = retrieve.top_k(q, docs, 5, by=["label"]).withColumn("collection", F.col("label").cast("string")).join(texts, "document_id")
    out = retrieve.fuse(hits, identity="identity").select("query_id", "document_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("final_rank").cast("long").alias("final_rank"))
    return out.where("final_rank <= 10")


@query("""WITH RECURSIVE f AS (SELECT o.query_id, o.document_id, o.final_rank, greatest(1, ceil(length(d.text) / 4.0))::BIGINT AS tokens
  FROM (""" + _FUSED + """) o JOIN documents d ON d.doc_id = o.document_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS k FROM f),
go AS (SELECT query_id, k, document_id, final_rank, tokens, tokens <= 1500 AS kept, CASE WHEN tokens <= 1500 THEN tokens ELSE 0 END AS used FROM n WHERE k = 1
  UNION ALL SELECT n.query_id, n.k, n.document_id, n.final_rank, n.tokens, go.used + n.tokens <= 1500, go.used + CASE WHEN go.used + n.tokens <= 1500 THEN n.tokens ELSE 0 END
  FROM go JOIN n ON n.query_id = go.query_id AND n.k = go.k + 1)
SELECT query_id, document_id, final_rank, tokens FROM go WHERE kept""")
def flagship_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Search every collection, fuse the ranks, and fill a budget of 1500 tokens with the documents found."""
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), text.estimated_tokens("text", 1).alias("cost"))
    hits = _fused(spark, d).join(texts, "document_id")
    out = retrieve.fit_budget(hits, 1500, cost=F.col("cost"), whole=True)
    return out.select("query_id", "document_id", F.col("final_rank").cast("long").alias("final_rank"), F.col("tokens").cast("long").alias("tokens"))


flagship = flagship_retrieval


@query()
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share an 8-gram with a benchmark item, reranked for it by words and code shape."""
    b, docs = read(spark, d, "benchmark"), read(spark, d, "documents")
    near = leakage.passage_overlaps(docs, b).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("document_id"), (F.col("shared") / (F.col("shared") + 10)).alias("score"))
    hits = near.join(docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")), "document_id").join(b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    out = retrieve.rerank(hits)
    return out.select("query_id", "document_id", F.round("reranking_score", 6).alias("score"), F.col("final_rank").cast("long").alias("final_rank"))


@query("""WITH RECURSIVE n AS (SELECT source, doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
go AS (SELECT source, doc_id, k, tokens, tokens <= 4000 AS kept, CASE WHEN tokens <= 4000 THEN tokens ELSE 0 END AS used FROM n WHERE k = 1
  UNION ALL SELECT n.source, n.doc_id, n.k, n.tokens, go.used + n.tokens <= 4000, go.used + CASE WHEN go.used + n.tokens <= 4000 THEN n.tokens ELSE 0 END FROM go JOIN n ON n.source = go.source AND n.k = go.k + 1)
SELECT source, doc_id, tokens FROM go WHERE kept""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("source", "doc_id", F.col("text").alias("content"))
    return retrieve.fit_budget(t, 4000, "source", "doc_id").select("source", "doc_id", F.col("tokens").cast("long").alias("tokens"))


@query()
def context_selection(spark: SparkSession, d: str) -> DataFrame:
    hits = _fused(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content")), "document_id")
    out = retrieve.select_context(hits, fixed_tokens=200, total=4096, reserve=1024, budget=1200, document_cap=500)
    return out.select("query_id", F.col("position").cast("long").alias("position"), "document_id", "state", F.col("tokens").cast("long").alias("tokens"), F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"))


@query(f"""WITH f AS ({_FUSED}), t AS (SELECT f.*, d.text, d.source, row_number() OVER (PARTITION BY query_id ORDER BY final_rank) AS n FROM f JOIN documents d ON d.doc_id = f.document_id)
SELECT query_id, md5(string_agg('[Context ' || n || ' | id=' || document_id || ' | source=' || source || ' | score=' || printf('%.6f', rrf_score) || ']' || chr(10) || {strip('text')}, chr(10) || chr(10) ORDER BY n)) AS context_md5
FROM t GROUP BY query_id""")
def context_render(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), "source")
    hits = _fused(spark, d).withColumnRenamed("rrf_score", "score").join(t, "document_id")
    return retrieve.render(hits).select("query_id", F.md5("context").alias("context_md5"))


# -- de-duplication and leakage -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({norm('text')}) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY sha256({norm('text')}) ORDER BY doc_id) = 1")
def exact_dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", text.content_identity("text").alias("h"))
    return index.first_wins(t, "h", "doc_id").select("doc_id", "h")


@query("SELECT source, count(*) AS received, count(DISTINCT text) AS \"unique\", count(*) - count(DISTINCT text) AS duplicates FROM documents GROUP BY source")
def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.dedup_counts(read(spark, d, "documents"), "text", "source")


def _kinds() -> dict[str, Column]:
    return {"full_text": text.content_identity("text"), "folded": F.sha2(F.lower(text.normalize_text("text")), 256)}


@query(f"""WITH k AS (SELECT doc_id, doc_id % 10 = 0 AS reserved, sha256({norm('text')}) AS full_text, sha256(lower({norm('text')})) AS folded FROM documents),
c AS (SELECT reserved, full_text, folded, min(doc_id) AS id, count(*) AS n FROM k GROUP BY ALL)
SELECT a.id AS indexed_id, b.id AS benchmark_id, CASE WHEN a.full_text = b.full_text THEN 'folded,full_text' ELSE 'folded' END AS matched_by, a.n AS indexed_rows, b.n AS benchmark_rows
FROM c a JOIN c b ON NOT a.reserved AND b.reserved AND a.folded = b.folded""")
def multi_key_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth document plays the reserved benchmark; which classes of equal rows share a key, which keys, and their sizes."""
    t = read(spark, d, "documents")
    a, b = leakage.keys(t.where("doc_id % 10 <> 0"), "doc_id", _kinds()), leakage.keys(t.where("doc_id % 10 = 0"), "doc_id", _kinds())
    return leakage.class_overlaps(a, b).withColumn("matched_by", F.array_join("matched_by", ","))


@query(f"""WITH b AS (SELECT * FROM documents WHERE doc_id % 10 = 0) SELECT doc_id FROM documents WHERE doc_id % 10 <> 0
AND sha256({norm('text')}) NOT IN (SELECT sha256({norm('text')}) FROM b) AND sha256(lower({norm('text')})) NOT IN (SELECT sha256(lower({norm('text')})) FROM b)""")
def disjoint_selection(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    a, b = t.where("doc_id % 10 <> 0"), t.where("doc_id % 10 = 0")
    hit = leakage.touched(leakage.keys(a, "doc_id", _kinds()), leakage.keys(b, "doc_id", _kinds()))
    return a.join(hit.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select("doc_id")


@query(r"""WITH w AS (SELECT {id} FROM documents), d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> ''] AS ws FROM documents),
dg AS (SELECT DISTINCT doc_id, unnest([array_to_string(ws[k:k + 7], ' ') FOR k IN generate_series(1, len(ws) - 7)]) AS gram FROM d WHERE len(ws) >= 8),
b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(lower(text), '\s+') IF x <> ''] AS ws FROM benchmark),
bg AS (SELECT DISTINCT item_id, unnest([array_to_string(ws[k:k + 7], ' ') FOR k IN generate_series(1, len(ws) - 7)]) AS gram FROM b WHERE len(ws) >= 8)
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (gram) GROUP BY 1, 2""".replace("w AS (SELECT {id} FROM documents), ", ""))
def benchmark_ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    return leakage.passage_overlaps(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query("""SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS partitions, count(*) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1""")
def group_overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    return leakage.group_overlaps(read(spark, d, "documents"), "source", "lang").select("source", F.array_join("partitions", ",").alias("partitions"), "n")


# -- evaluation ---------------------------------------------------------------------------------------------------

_PAIRS = "WITH p AS (SELECT a.conv_id, a.turn, a.role, a.text AS reference, b.text AS prediction FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return c.withColumnRenamed("text", "reference").join(nxt, ["conv_id", "turn"])


_F1 = f"""w AS (SELECT *, list_distinct({word_list('lower(reference)')}) AS a, list_distinct({word_list('lower(prediction)')}) AS b FROM p),
x AS (SELECT *, len(list_intersect(a, b))::DOUBLE AS c FROM w),
s AS (SELECT conv_id, turn, role, CASE WHEN trim(reference) = trim(prediction) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em,
  CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 OR c = 0 THEN 0.0::DOUBLE ELSE 2 * (c / len(b)) * (c / len(a)) / (c / len(b) + c / len(a)) END AS f1 FROM x)"""


@query(f"{_PAIRS}, {_F1} SELECT conv_id, turn, round(f1, 6) AS token_f1, em AS exact_match FROM s")
def token_f1_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = text.text_metrics("reference", "reference", "prediction")
    return _pairs(spark, d).select("conv_id", "turn", F.round(text.token_f1("reference", "prediction"), 6).alias("token_f1"), m["exact_match"].alias("exact_match"))


@query(f"{_PAIRS}, {_F1} SELECT role, count(*) AS count, round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS token_f1 FROM s GROUP BY ROLLUP (role)")
def domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.rollup_scores(_pairs(spark, d), "role")
    return r.select("role", "count", F.round("exact_match", 6).alias("exact_match"), F.round("token_f1", 6).alias("token_f1"))


@query()
def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", F.round(code.edit_similarity("reference", "prediction"), 6).alias("similarity"))


@query("""SELECT source AS model, count(*) AS count, round(avg(quality), 6) AS avg_quality, round(median(quality), 6) AS median_quality, min(quality) AS min_quality, max(quality) AS max_quality,
  round(avg(toxic), 6) AS toxic_rate, round(avg(n_chars), 4) AS avg_chars, round(median(n_chars), 4) AS median_chars FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def model_aggregate_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", "source", "n_chars").join(read(spark, d, "labels"), "doc_id")
    r = lambda c, n=6: F.round(c, n)
    return t.groupBy(F.col("source").alias("model")).agg(
        F.count("*").alias("count"), r(evaluate.mean("quality")).alias("avg_quality"), r(evaluate.median("quality")).alias("median_quality"), F.min("quality").alias("min_quality"),
        F.max("quality").alias("max_quality"), r(evaluate.mean("toxic")).alias("toxic_rate"), r(evaluate.mean("n_chars"), 4).alias("avg_chars"), r(evaluate.median("n_chars"), 4).alias("median_chars"),
    )


@query("""WITH m AS (SELECT source, avg(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, round(q, 6) AS q FROM m ORDER BY q DESC, source LIMIT 1""")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("q"))
    return evaluate.best(t, "q", "source").select("source", F.round("q", 6).alias("q"))


@query("""WITH m AS (SELECT lang, source, avg(quality) AS v FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'de') GROUP BY 1, 2),
x AS (SELECT lang AS task, max(CASE WHEN source = CASE lang WHEN 'en' THEN 'src1' ELSE 'src2' END THEN v END) AS specialised, max(CASE WHEN source = 'src0' THEN v END) AS shared FROM m GROUP BY lang)
SELECT task, round(specialised, 6) AS specialised, round(shared, 6) AS shared, round(shared - specialised, 6) AS difference, round(CASE WHEN specialised <> 0 THEN 100 * (shared - specialised) / specialised END, 4) AS percent FROM x""")
def interference_table(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", "lang", "source").join(read(spark, d, "labels"), "doc_id")
    m = t.groupBy(F.col("lang").alias("task"), F.col("source").alias("model")).agg(F.avg("quality").alias("value"))
    r = evaluate.interference(m, "src0", {"en": "src1", "de": "src2"})
    return r.select("task", *[F.round(c, 6).alias(c) for c in ("specialised", "shared", "difference")], F.round("percent", 4).alias("percent"))


@query("""SELECT lang AS split, count(*) AS n, round(avg(length(text)), 4) AS avg_input, round(avg(length(source)), 4) AS avg_output FROM documents GROUP BY lang""")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    s = prep.split_stats(read(spark, d, "documents"), "lang", "text", "source")
    return s.select(F.col("lang").alias("split"), "n", F.round("avg_input", 4).alias("avg_input"), F.round("avg_output", 4).alias("avg_output"))


_MODULES = f"""WITH o AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS key, embedding::DOUBLE[] AS embedding FROM embeddings),
p AS (SELECT a.label AS l, b.label AS r, a.key, a.embedding, b.embedding AS qe FROM o a JOIN o b ON a.key = b.key AND a.label::VARCHAR < b.label::VARCHAR),
c AS (SELECT l, r, key, {_COS} AS cosine, {_L2} AS l2 FROM p)"""


@query(_MODULES + """ SELECT l::VARCHAR AS "left", r::VARCHAR AS "right", CAST(key % 5 AS BIGINT) AS layer, count(*) AS n, round(avg(cosine), 6) AS mean_cosine, round(median(cosine), 6) AS median_cosine, round(avg(l2), 6) AS mean_l2
FROM c GROUP BY GROUPING SETS ((l, r, key % 5), (l, r))""")
def pairwise_similarity_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Labels play the models, places within a label the modules, places modulo 5 the layers."""
    e = prep.ranks(read(spark, d, "embeddings"), ["vec_id"], "module_key", by=["label"])
    one = e.select(F.col("label").cast("string").alias("model"), "module_key", F.col("embedding").alias("vector"))
    rows = evaluate.all_similarities(one).withColumn("layer", F.col("module_key") % 5)
    r = evaluate.similarity_levels(rows, "layer")
    return r.select("left", "right", "layer", "n", *[F.round(c, 6).alias(c) for c in ("mean_cosine", "median_cosine", "mean_l2")])


@query("""WITH g AS (SELECT label, vec_id % 20 AS layer, sum(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS norm FROM embeddings GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(norm, 6) DESC, layer) AS rank FROM g) SELECT label, layer::BIGINT AS layer, round(norm, 6) AS norm, rank::BIGINT AS rank FROM r WHERE rank <= 5""")
def top_layers(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 20).alias("layer")).agg(F.round(F.sum(vector.norm("embedding")), 6).alias("norm"))
    return evaluate.top_groups(g, "label", "layer", "norm").select("label", "layer", "norm", F.col("rank").cast("long").alias("rank"))


# -- run logs -------------------------------------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as run records: a user is a run, events in order of time are attempts, the type is the mode."""
    return read(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("attempt"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("mode"),
        (F.col("user_id") % 7).alias("task"), F.col("value").alias("score"), F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"),
    )


_RUNS = "WITH r AS (SELECT user_id AS run_id, ts AS attempt, event_id AS ordinal, event_type AS mode, user_id % 7 AS task, value AS score, CASE WHEN value > 50 THEN 'success' ELSE 'failed' END AS status FROM events)"


@query(_RUNS + " SELECT run_id, ordinal, mode, status, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC, ordinal DESC) = 1")
def latest_attempt(spark: SparkSession, d: str) -> DataFrame:
    return matrix.latest(_runs(spark, d)).select("run_id", "ordinal", "mode", "status", F.round("score", 6).alias("score"))


@query(_RUNS + " SELECT task, mode, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS success, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, round(avg(score), 4) AS average_score FROM r GROUP BY 1, 2")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    s = matrix.summary(_runs(spark, d))
    return s.select("task", "mode", "success", "failed", F.round("average_score", 4).alias("average_score"))


@query(_RUNS + " SELECT mode AS error_type, count(*) AS n FROM r WHERE status = 'failed' GROUP BY mode")
def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    return matrix.failures(_runs(spark, d).withColumn("error_type", F.col("mode")))


_MODES = ["click", "purchase", "view"]


@query(_RUNS + """, l AS (SELECT * FROM r WHERE mode IN ('click', 'purchase', 'view') QUALIFY row_number() OVER (PARTITION BY run_id, mode ORDER BY attempt DESC, ordinal DESC) = 1)
SELECT run_id AS case_id, coalesce(max(CASE WHEN mode = 'click' THEN status END), 'not_run') AS click_status, round(max(CASE WHEN mode = 'click' THEN score END), 6) AS click_score,
 coalesce(max(CASE WHEN mode = 'purchase' THEN status END), 'not_run') AS purchase_status, round(max(CASE WHEN mode = 'purchase' THEN score END), 6) AS purchase_score,
 coalesce(max(CASE WHEN mode = 'view' THEN status END), 'not_run') AS view_status, round(max(CASE WHEN mode = 'view' THEN score END), 6) AS view_score,
 coalesce(first(mode ORDER BY score DESC, mode), '') AS best_mode FROM l GROUP BY run_id""")
def case_pivot(spark: SparkSession, d: str) -> DataFrame:
    last = matrix.latest(_runs(spark, d).where(F.col("mode").isin(*_MODES)), ["run_id", "mode"]).withColumnRenamed("run_id", "case_id")
    p = evaluate.case_pivot(last, _MODES)
    return p.select("case_id", "best_mode", *[f"{m}_status" for m in _MODES], *[F.round(f"{m}_score", 6).alias(f"{m}_score") for m in _MODES])


@query(_RUNS + """, c AS (SELECT DISTINCT run_id, m.mode FROM r, (VALUES ('click'), ('purchase'), ('view')) AS m(mode)),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id, mode ORDER BY attempt DESC, ordinal DESC) = 1)
SELECT c.run_id, c.mode, l.status AS last_status, CASE WHEN l.status IS NULL THEN false WHEN l.status = 'success' THEN false ELSE true END AS runs FROM c LEFT JOIN l USING (run_id, mode)""")
def planned_matrix_resume(spark: SparkSession, d: str) -> DataFrame:
    """All cases with all modes, and which cells run when only failed ones are tried again."""
    r = _runs(spark, d)
    modes = spark.createDataFrame([(m,) for m in _MODES], "mode string")
    cells = filters.select_runs(r.select(F.col("run_id").alias("case_id")).distinct(), modes).withColumnRenamed("case_id", "run_id")
    return matrix.plan(cells, r, ["run_id", "mode"], retry_failed=True).select("run_id", "mode", "last_status", "runs")


# -- splits -----------------------------------------------------------------------------------------------------------

_ORDER = "md5('42:' || doc_id)"


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r""")
def ratio_split(spark: SparkSession, d: str) -> DataFrame:
    return prep.ratio_split(read(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query()
def group_ratio_split(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", "source")
    return prep.group_split_by_ratio(t, "source", {"train": 0.7, "val": 0.15, "test": 0.15}).select("doc_id", "source", "split")


@query(f"""SELECT * FROM (SELECT doc_id, 'en' AS part FROM documents WHERE lang = 'en' ORDER BY {_ORDER}, doc_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT doc_id, 'de' AS part FROM documents WHERE lang = 'de' ORDER BY {_ORDER}, doc_id LIMIT 50)""")
def balanced_mix(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", "lang")
    return prep.balanced_mix({x: t.where(F.col("lang") == x) for x in ("en", "de")}, 50, "doc_id").select("doc_id", "part")


# -- chunks and code --------------------------------------------------------------------------------------------------


@query()
def prose_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunk.chunk_documents(read(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"), "content_hash", "chunk_id")


@query(f"""WITH t AS (SELECT source, [x FOR x IN [{strip('y')} FOR y IN regexp_split_to_array(text, '\\r\\n|[\\n\\x0B\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')] IF x <> ''] AS ls FROM documents),
e AS (SELECT source, unnest([{{'place': 'header', 'line': ls[1]}}, {{'place': 'footer', 'line': ls[-1]}}]) AS x FROM t WHERE len(ls) > 0),
k AS (SELECT source, x.place AS place, regexp_replace({norm('lower(x.line)')}, '[0-9]+', '#', 'g') AS key FROM e),
n AS (SELECT source, place, count(*) AS pages FROM k GROUP BY ALL)
SELECT source, place, key, count(*) AS n FROM k JOIN n USING (source, place) WHERE pages >= 2 GROUP BY source, place, key, pages HAVING count(*) >= greatest(2, ceil(pages * 0.02)) AND key <> ''""")
def repeated_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """First and last lines that at least 2 % of a source's documents share (sources play documents, documents pages)."""
    return chunk.repeated_boundaries(read(spark, d, "documents"), "source", "text", 0.02).select("source", "place", "key", "n")


@query(r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '[{}]') AS ms FROM pages), x AS (SELECT page_id, unnest(ms) AS c, generate_subscripts(ms, 1) AS k FROM m),
s AS (SELECT page_id, k, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY k) AS s FROM x),
f AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY k)) AS depth FROM s), g AS (SELECT page_id, max(depth)::BIGINT AS depth FROM f GROUP BY page_id)
SELECT page_id, len(regexp_extract_all(html, '\{'))::BIGINT AS opens, length(html) AS chars, len(string_split(html, chr(10)))::BIGINT AS lines,
 len(regexp_extract_all(html, '&&|\|\|'))::BIGINT AS logical, len(regexp_extract_all(html, '\bif\s*\('))::BIGINT AS ifs, coalesce(g.depth, 0) AS depth FROM pages LEFT JOIN g USING (page_id)""")
def code_counts(spark: SparkSession, d: str) -> DataFrame:
    m = code.code_metrics("html")
    return read(spark, d, "pages").select(
        "page_id", code.count(F.col("html"), r"\{").cast("long").alias("opens"), F.length("html").cast("long").alias("chars"), F.size(F.split("html", "\n", -1)).cast("long").alias("lines"),
        m["logical_operator_count"].cast("long").alias("logical"), m["if_count"].cast("long").alias("ifs"), m["max_brace_nesting_depth"].cast("long").alias("depth"),
    )


@query()
def code_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = code.with_code_metrics(read(spark, d, "pages").select("page_id", "html"), "html", "m_")
    m = {c[2:]: F.col(c) for c in p.columns if c.startswith("m_")}
    return p.select("page_id", *[F.round(c, 6).alias(k) for k, c in m.items()], F.round(code.cohesion(m), 6).alias("cohesion"), F.round(code.coupling(m), 6).alias("coupling"))


@query()
def refactoring_quality(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("conv_id", "turn", "role", F.col("reference").alias("input"), F.col("reference").alias("expected_output"), "prediction")
    r = evaluate.refactoring_aggregate(evaluate.refactoring_rows(p), ["role"])
    return r.select("role", *[F.round(c, 6).alias(c) for c in r.columns if c != "role"])


@query()
def testing_quality(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("role", F.col("reference").alias("input"), "prediction")
    r = evaluate.testing_aggregate(evaluate.testing_rows(p), ["role"])
    return r.select("role", *[F.round(c, 6).alias(c) for c in r.columns if c != "role"])


@query(r"""SELECT doc_id, regexp_extract(text, '\b(boolean|byte|short|int|long|float|double|char|void|String|[A-Za-z_$][A-Za-z0-9_$<>.?\[\]]*)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(([^)]*)\)', 2) AS method_name FROM documents""")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.regexp_extract("text", code.SIGNATURE, 2).alias("method_name"))


@query()
def java_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The first method of every page, by its head."""
    return read(spark, d, "pages").select("page_id", chunk.java_signature("html").alias("s")).select("page_id", "s.return_type", "s.method_name", F.array_join("s.parameter_types", ",").alias("parameter_types"), "s.class_name", "s.start_line")


@query("""SELECT page_id, sha256('' || '|' || '' || '|' || coalesce(url, '') || '|0|rag-v2|' || sha256(regexp_replace(regexp_replace(replace(html, chr(13) || chr(10), chr(10)), '(?m)[ \\t]+$', '', 'g'), '^\\s+|\\s+$', '', 'g'))) AS document_id,
  length(html) AS chars, 'whole_document_fallback' AS chunk_type FROM pages""")
def java_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Java-aware chunks of all pages. They declare no methods, so each is one whole document; Java sources are in the unit tests."""
    t = read(spark, d, "pages").select("page_id", F.lit("").alias("dataset"), F.lit("").alias("split"), F.col("url").alias("source_uri"), F.col("html").alias("content"))
    return knowledge.java_chunks(t).select("page_id", "document_id", F.length("content").cast("long").alias("chars"), "chunk_type")


@query("""SELECT doc_id, source <> '' OR FALSE AS by_case, (lang <> '' AND source <> '' AND doc_id % 2 = 0) AS by_file, (lang <> '' AND source <> '' AND doc_id % 3 = 0) AS by_method FROM documents""")
def specific_identities(spark: SparkSession, d: str) -> DataFrame:
    """Whether an identity names one case, one file of a commit or one method of a class, or only a data set."""
    some = lambda k: F.when(F.col("doc_id") % k == 0, F.lit("x"))
    return read(spark, d, "documents").select(
        "doc_id", filters.specific_identity(case_id=F.col("source")).alias("by_case"),
        filters.specific_identity(repository=F.col("lang"), commit=F.col("source"), file_path=some(2)).alias("by_file"),
        filters.specific_identity(repository=F.col("lang"), class_name=F.col("source"), method_name=some(3)).alias("by_method"),
    )


def _prompt_sql(evidence: str) -> str:
    t = prompt.template("testing").replace("'", "''")
    parts = {"requirements": strip("lang"), "source": strip("text"), "project": f"coalesce(nullif({strip('source')}, ''), 'None.')", "evidence": evidence}
    out = f"'{t}'"
    for k, marker in prompt.MARKERS.items():
        out = f"replace({out}, '{marker}', {parts[k]})"
    return out


@query(f"""SELECT doc_id, sha256({_prompt_sql("'None.'")}) AS full_prompt_sha256, sha256({_prompt_sql(f"'{prompt.PLACEHOLDER}'")}) AS normalized_prompt_sha256,
  sha256('{prompt.template('testing').replace("'", "''")}') AS prompt_template_sha256 FROM documents""")
def prompt_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.lit("testing").alias("task"), F.col("lang").alias("instruction"), F.col("text").alias("input"), F.col("source").alias("project_context"))
    return prompt.build(t, "direct").select("doc_id", "full_prompt_sha256", "normalized_prompt_sha256", "prompt_template_sha256")


@query(f"""SELECT doc_id, true AS passed, sha256({_prompt_sql(f"'{prompt.PLACEHOLDER}'")}) AS normalized_prompt_sha256 FROM documents""")
def prompt_fairness(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.lit("testing").alias("task"), F.col("lang").alias("instruction"), F.col("text").alias("input"), F.col("source").alias("project_context"))
    return prompt.audit(t, "doc_id").select("doc_id", "passed", "normalized_prompt_sha256")


@query(f"""SELECT conv_id, turn, sha256('original|' || {strip('text')}) AS code_id,
  'handmade|' || conv_id || '|||a/b.java||' || lower({strip('role')}) AS canonical FROM conversations""")
def sample_identities(spark: SparkSession, d: str) -> DataFrame:
    of = identity.identity(dataset=F.lit("Handmade"), case_id="conv_id", file_path=F.lit("a\\B.java"), method_name="role")
    return read(spark, d, "conversations").select("conv_id", "turn", identity.code_id("original", "text").alias("code_id"), identity.canonical(of).alias("canonical"))


@query()
def knowledge_documents(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring turns as records of the two domains: document, pair and code ids, and the chunk of each in its collection."""
    p = _pairs(spark, d).where(f"{_filled('reference')} AND {_filled('prediction')}")
    r = p.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.when(F.col("conv_id") % 2 == 0, "testing").otherwise("refactoring").alias("domain"), F.col("reference").alias("input"), F.col("prediction").alias("output"))
    docs = knowledge.documents(r, "turns", "turns.jsonl")
    c = knowledge.corpora(docs.where("task = 'refactoring'"), docs.where("task = 'testing'"))
    return c.select("knowledge_id", "document_id", "collection", "content_hash", "chunk_type", F.sha2("embedding_text", 256).alias("embedding_text_sha256"))


def _filled(c: str) -> str:
    return f"trim({c}) <> ''"


@query(_RUNS + """, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC, ordinal DESC) = 1) SELECT status, count(*) AS n FROM l GROUP BY status""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.status_counts(matrix.latest(_runs(spark, d)))


@query("""SELECT doc_id, source, lang FROM documents ORDER BY length(text) + length(source) DESC, doc_id LIMIT 1""")
def longest_example(spark: SparkSession, d: str) -> DataFrame:
    return records.longest_example(read(spark, d, "documents").select("doc_id", "text", "source", "lang"), "text", "source", "doc_id").select("doc_id", "source", "lang")


@query("""WITH l AS (SELECT user_id, event_id AS step, CASE WHEN event_type = 'view' THEN value END AS eval_loss, CASE WHEN event_type <> 'view' THEN value END AS loss FROM events)
SELECT user_id, round(min(eval_loss), 6) AS best_eval_loss, round(arg_max(eval_loss, step) FILTER (eval_loss IS NOT NULL), 6) AS last_eval_loss, round(arg_max(loss, step) FILTER (loss IS NOT NULL), 6) AS last_train_loss FROM l GROUP BY user_id""")
def training_losses(spark: SparkSession, d: str) -> DataFrame:
    view = F.col("event_type") == "view"
    log = read(spark, d, "events").select("user_id", F.col("event_id").alias("step"), F.when(view, F.col("value")).alias("eval_loss"), F.when(~view, F.col("value")).alias("loss"))
    out = records.losses(log, "step", ["user_id"])
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("best_eval_loss", "last_eval_loss", "last_train_loss")])


@query(f"""WITH f AS ({_FUSED}), u AS (SELECT query_id, document_id FROM f WHERE final_rank <= 3)
SELECT f.query_id, f.document_id, u.document_id IS NOT NULL AS used_in_prompt FROM f LEFT JOIN u USING (query_id, document_id)""")
def used_in_prompt(spark: SparkSession, d: str) -> DataFrame:
    hits = _fused(spark, d)
    return records.used_in_prompt(hits, hits.where("final_rank <= 3")).select("query_id", "document_id", "used_in_prompt")


@query("""SELECT 'm:testing:' || doc_id AS id, 'm' AS model_name, 'testing' AS task, text AS input, lang AS expected_output, source AS prediction FROM documents""".replace("text AS input", "CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN '' ELSE text END AS input"))
def prediction_records(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("output"), F.col("source").alias("generated_output"))
    return records.predictions(t, "testing", "m", "doc_id").select("id", "model_name", "task", "input", "expected_output", "prediction")


@query("""SELECT label % 3 AS layer, sum(n) FILTER (m = 'a') AS a_sum, max(n) FILTER (m = 'a') AS a_max, count(n) FILTER (m = 'a') AS a_n, sum(n) FILTER (m = 'b') AS b_sum, max(n) FILTER (m = 'b') AS b_max, count(n) FILTER (m = 'b') AS b_n
FROM (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS m, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) AS n FROM embeddings) GROUP BY 1""".replace("sum(n) FILTER (m = 'a')", "round(sum(n) FILTER (m = 'a'), 4)").replace("sum(n) FILTER (m = 'b')", "round(sum(n) FILTER (m = 'b'), 4)"))
def layer_norms(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select((F.col("label") % 3).alias("layer"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("model"), F.round(vector.norm("embedding"), 3).alias("norm"))
    r = evaluate.layer_norms(e, ["a", "b"])
    return r.select("layer", F.round("a_sum", 4).alias("a_sum"), "a_max", "a_n", F.round("b_sum", 4).alias("b_sum"), "b_max", "b_n")


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' TRUE' WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN round(value, 2)::VARCHAR WHEN 3 THEN event_type WHEN 4 THEN '1e3' END AS v FROM events)
SELECT event_id, CASE WHEN lower(trim(v)) IN ('true', 'false') THEN 'bool' WHEN TRY_CAST(v AS BIGINT) IS NOT NULL AND v NOT LIKE '%.%' AND v NOT LIKE '%e%' THEN 'int' WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'float' WHEN v IS NOT NULL THEN 'str' END AS kind FROM t""")
def literal_kinds(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("event_id") % 6, F.col("value")
    t = F.when(k == 0, " TRUE").when(k == 1, F.col("user_id").cast("string")).when(k == 2, F.round(v, 2).cast("string")).when(k == 3, F.col("event_type")).when(k == 4, "1e3")
    return read(spark, d, "events").select("event_id", text.scalar_kind(t).alias("kind"))


@query("""SELECT n_name, o_orderstatus, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2""")
def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, n = (read(spark, d, t) for t in ("customer", "orders", "lineitem", "nation"))
    j = li.where("l_shipdate >= TIMESTAMP '1995-01-01'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
