"""Queries of ranked retrieval.

Searches for many take as queries the rows whose id is divisible by 20, against all rows; those of one
literal query show the single-query plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import plain
from docweft.functions import text as tx
from docweft.operators import evaluation, fusion, hybrid, lexical, snippets, tickets, vector
from docweft.plans import sql
from docweft.plans.text_queries import AS_OF, live_docs
from docweft.session import spread, table
from docweft.settings import DEFAULTS, merged

QUERY = "배수펌프 점검 이력 알려줘"
#: Chunks take their vectors from so many places, of which the table fills a part; the vector that is asked for.
PLACES, ASKED_VECTOR = 2500, 7
SYNONYMS = {"배수펌프": ["배수모터", "오수펌프"], "점검": ["검수"]}


def chunk_table(spark: SparkSession, root: str) -> DataFrame:
    """Stored chunks with the columns of search; their change time as a timestamp."""
    return spread(table(spark, root, "chunks")).withColumn("updated_at", F.col("updated_at").try_cast("timestamp"))


def title_queries(spark: SparkSession, root: str) -> DataFrame:
    """Titles of the tickets whose number is divisible by 20."""
    return table(spark, root, "maintenance_requests").filter("idx % 20 = 0 and title is not null").groupBy(F.col("idx").alias("query_id")).agg(F.min("title").alias("query"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(lexical.TermIndex(chunk_table(spark, root)).best(title_queries(spark, root), 10))


def bm25_distinct_topk(spark: SparkSession, root: str) -> DataFrame:
    return _rounded(_lemma_index(spark, root).scanned(title_queries(spark, root), 10, k1=1.2, tokens=tx.lemma_tokens, repeated=False))


def _lemma_index(spark: SparkSession, root: str) -> lexical.TermIndex:
    """Lemmas of chunks: a chunk's length is a third of its lemmas as a text, the mean a third of its body's."""
    return lexical.TermIndex(chunk_table(spark, root), text=F.concat_ws(" ", F.coalesce("body", F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("title", F.lit(""))), tokens=tx.lemma_tokens, length=lambda t: F.length(F.array_join(t, " ")) / 3.0, mean_of=F.length(F.coalesce("body", F.lit(""))) / 3.0)


def doc_grouped_search(spark: SparkSession, root: str) -> DataFrame:
    chunks = chunk_table(spark, root)
    ranked = lexical.TermIndex(chunks).best(title_queries(spark, root), 20)
    return lexical.grouped_by_document(ranked, chunks, 5).select("query_id", "document_id", "chunk_id", "score", "rank", F.array_join("related", ",").alias("related"))


def ngram_jaccard_topk(spark: SparkSession, root: str) -> DataFrame:
    scores = lexical.ngram_scores(lexical.ngram_features(chunk_table(spark, root)), QUERY).withColumn("query_id", F.lit(0))
    return scores.orderBy(F.round("score", 9).desc(), "chunk_id").limit(20).select("chunk_id", F.round("score", 6).alias("score"))


def weighted_fields(spark: SparkSession, root: str) -> DataFrame:
    live = chunk_table(spark, root).join(live_docs(spark, root).select("source"), "source", "left_semi")
    scored = lexical.field_scores(live, plain.search_terms(QUERY))
    return lexical.best_fields(scored, 50).select("chunk_id", F.col("match_score").cast("bigint").alias("match_score"))


def weighted_fields_v2(spark: SparkSession, root: str) -> DataFrame:
    live = chunk_table(spark, root).join(live_docs(spark, root).select("source"), "source", "left_semi")
    scored = lexical.field_scores(live, plain.search_terms(QUERY), lexical.FIELD_WEIGHTS_V2)
    return lexical.best_fields(scored, 50).select("chunk_id", F.col("match_score").cast("bigint").alias("match_score"))


def ngram_jaccard_titles(spark: SparkSession, root: str) -> DataFrame:
    """ngram_jaccard_topk of many."""
    return _rounded(lexical.ngram_best_of(chunk_table(spark, root), title_queries(spark, root), 20))


def _weighted_titles(spark: SparkSession, root: str, weights: dict[str, int]) -> DataFrame:
    live = chunk_table(spark, root).join(live_docs(spark, root).select("source"), "source", "left_semi")
    best = lexical.field_best_of(live, title_queries(spark, root), 50, weights)
    return best.select("query_id", "chunk_id", F.col("match_score").cast("bigint").alias("match_score"), F.col("rank").cast("bigint").alias("rank"))


def weighted_fields_titles(spark: SparkSession, root: str) -> DataFrame:
    """weighted_fields of many."""
    return _weighted_titles(spark, root, lexical.FIELD_WEIGHTS)


def weighted_fields_v2_titles(spark: SparkSession, root: str) -> DataFrame:
    """weighted_fields_v2 of many."""
    return _weighted_titles(spark, root, lexical.FIELD_WEIGHTS_V2)


def document_scores(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(live_docs(spark, root).select("source", "title", "customer", "content"))
    return lexical.document_scores(docs, QUERY).filter("score > 0").select("source", "score")


def ticket_search(spark: SparkSession, root: str) -> DataFrame:
    own = tickets.unique_tickets(table(spark, root, "maintenance_requests"))
    text = tx.collapsed(F.concat_ws("\n", F.col("idx").cast("string"), "user_id", "title", "report_title", "notes"))
    found = tickets.search(own.withColumn("search_text", text), "점검 요청", 50)
    return found.select("idx", F.col("score").cast("bigint").alias("score"))


def knn_cosine(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "embeddings")
    return vector.nearest(own, own.filter("vec_id % 20 = 0"), 10, clamp=False).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def knn_cells(spark: SparkSession, root: str) -> DataFrame:
    """knn_cosine by the index, looking into all cells, which makes it exact."""
    own = table(spark, root, "embeddings")
    found = vector.Index(own, part_rows=200).nearest(own.filter("vec_id % 20 = 0"), 10, probes=1 << 20, clamp=False)
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


def knn_metrics(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "embeddings")
    found = vector.nearest(own, own.filter("vec_id % 20 = 0"), 10, clamp=False)
    labels = own.select("vec_id", "label")
    judged = found.join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    first = evaluation.first_match(judged, F.col("label") == F.col("want"))
    out = evaluation.metrics(own.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), first)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr")])


def _hybrid(spark: SparkSession, root: str, mode: str, vectors: DataFrame | None = None, **more) -> DataFrame:
    settings = merged(DEFAULTS, {"synonyms": SYNONYMS})
    found = hybrid.search(chunk_table(spark, root), QUERY, F.lit(AS_OF).cast("timestamp"), 20, mode, settings, vectors, **more)
    return found.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("bm25", "ngram", "embedding", "field_boost", "exact_match_boost", "recency_boost", "score")], F.array_join("sources", "+").alias("sources"))


def chunk_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(chunk_id, embedding): vectors of the table embeddings for chunks, by a hash of their ids; some have none."""
    place = F.conv(F.substring(F.md5("chunk_id"), 1, 7), 16, 10).cast("bigint") % PLACES
    return table(spark, root, "chunks").select("chunk_id", place.alias("vec_id")).join(table(spark, root, "embeddings").select("vec_id", "embedding"), "vec_id").select("chunk_id", "embedding")


def _query_vector(spark: SparkSession, root: str) -> list[float]:
    return table(spark, root, "embeddings").filter(F.col("vec_id") == ASKED_VECTOR).first().embedding


def _with_vectors(spark: SparkSession, root: str) -> dict:
    own, asked = chunk_vectors(spark, root), _query_vector(spark, root)
    return {"vectors": vector.nearest_to(own, asked, 50), "embeddings": own, "query_vector": asked}


def hybrid_vectors(spark: SparkSession, root: str) -> DataFrame:
    return _hybrid(spark, root, "hybrid", **_with_vectors(spark, root))


def mode_vector_only(spark: SparkSession, root: str) -> DataFrame:
    return _hybrid(spark, root, "vector_only", **_with_vectors(spark, root))


def nearest_chunks(spark: SparkSession, root: str) -> DataFrame:
    found = vector.nearest_to(chunk_vectors(spark, root), _query_vector(spark, root), 50)
    return found.select("chunk_id", F.round("similarity", 6).alias("similarity"))


def hybrid_blend(spark: SparkSession, root: str) -> DataFrame:
    return _hybrid(spark, root, "hybrid")


def mode_bm25_only(spark: SparkSession, root: str) -> DataFrame:
    return _hybrid(spark, root, "bm25_only")


def mode_ngram_only(spark: SparkSession, root: str) -> DataFrame:
    return _hybrid(spark, root, "ngram_only")


def hash_vectors(spark: SparkSession, root: str, query: str, k: int = 50) -> DataFrame:
    """Nearest chunks to a query by hashed embeddings."""
    from docweft.functions.vectors import hash_embedding

    chunks = chunk_table(spark, root)
    text = tx.embedding_text(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "folder", "filename", "heading", "body")])
    own = chunks.select("chunk_id", F.xxhash64("chunk_id").alias("vec_id"), hash_embedding(text).alias("embedding"))
    asked = spark.createDataFrame([(0, plain.hash_vector(plain.normalize(query), 384))], "vec_id bigint, embedding array<double>")
    found = vector.nearest(own.select("vec_id", "embedding"), asked, k)
    return found.select(F.col("id").alias("vec_id"), "similarity").join(chunks.select("chunk_id", F.xxhash64("chunk_id").alias("vec_id")), "vec_id").select("chunk_id", "similarity")


def hybrid_hash_vectors(spark: SparkSession, root: str) -> DataFrame:
    return _hybrid(spark, root, "hybrid", hash_vectors(spark, root, QUERY))


def _stored(spark: SparkSession, root: str, vectors: DataFrame | None = None) -> DataFrame:
    settings = merged(DEFAULTS, {"synonyms": SYNONYMS})
    found = hybrid.stored_search(chunk_table(spark, root), table(spark, root, "maintenance_docs"), QUERY, F.lit(AS_OF).cast("timestamp"), 20, settings, vectors, vectors is not None)
    return found.select("chunk_id", "source", F.round("score", 6).alias("score"))


def stored_search(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, root)


def stored_vectors(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, root, vector.nearest_to(chunk_vectors(spark, root), _query_vector(spark, root), 50))


def _v2(spark: SparkSession, root: str, vectors: DataFrame | None = None) -> DataFrame:
    found = hybrid.search_v2(chunk_table(spark, root), table(spark, root, "maintenance_docs"), QUERY, F.lit(AS_OF).cast("timestamp"), 20, vectors=vectors)
    return found.select("chunk_id", F.round("lexical", 6).alias("lexical"), F.round("vector", 6).alias("vector"), F.round("ngram", 6).alias("ngram"), F.round("score", 6).alias("score"))


def v2_blend(spark: SparkSession, root: str) -> DataFrame:
    return _v2(spark, root).drop("vector")


def v2_vectors(spark: SparkSession, root: str) -> DataFrame:
    return _v2(spark, root, vector.nearest_to(chunk_vectors(spark, root), _query_vector(spark, root), 50))


def _runs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    chunks, asked = chunk_table(spark, root), title_queries(spark, root)
    body = lexical.TermIndex(chunks, text=F.coalesce("body", F.lit("")))
    head = lexical.TermIndex(chunks, text=lexical.searchable("title", "heading"))
    return {"body": body.best(asked, 30), "head": head.best(asked, 20)}


def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    fused = fusion.reciprocal_rank(_runs(spark, root), {"body": 1.0, "head": 1.2})
    best = lexical.top_k(fused, 10)
    return best.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "via", F.col("rank").cast("bigint").alias("rank"))


def candidate_provenance(spark: SparkSession, root: str) -> DataFrame:
    return fusion.with_provenance(_runs(spark, root)).select("query_id", "chunk_id", F.array_join("sources", "+").alias("sources"))


def _cases(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, query, want): titles of live documents whose number is divisible by 20, and their sources."""
    return live_docs(spark, root).filter("doc_pk % 20 = 0 and title is not null").select(F.col("doc_pk").alias("query_id"), F.col("title").alias("query"), F.col("source").alias("want"))


def _judged_runs(spark: SparkSession, root: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    chunks, cases = chunk_table(spark, root), _cases(spark, root)
    asked, sources = cases.select("query_id", "query"), chunks.select("chunk_id", "source")
    runs = {"bm25": lexical.TermIndex(chunks).scanned(asked, 10), "ngram": lexical.ngram_best_of(chunks, asked, 10)}
    return cases.select("query_id", "want"), {name: best.join(sources, "chunk_id") for name, best in runs.items()}


def eval_modes(spark: SparkSession, root: str) -> DataFrame:
    cases, runs = _judged_runs(spark, root)
    found = evaluation.compared(cases, runs, F.col("source") == F.col("want"))
    return found.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr")])


def eval_complement(spark: SparkSession, root: str) -> DataFrame:
    cases, runs = _judged_runs(spark, root)
    solved = [evaluation.first_match(run.join(cases, "query_id"), F.col("source") == F.col("want")).filter("first_rank <= 5") for run in runs.values()]
    return evaluation.complement(*solved).groupBy("solved_by").agg(F.count("*").alias("n"))


def eval_recall(spark: SparkSession, root: str) -> DataFrame:
    """Mean share of a document's chunks among the first ten for its title."""
    cases, runs = _judged_runs(spark, root)
    wanted = cases.join(chunk_table(spark, root).select("chunk_id", F.col("source").alias("want")), "want").select("query_id", "chunk_id")
    return evaluation.recall(wanted, runs["bm25"], 10).select(F.round("recall", 6).alias("recall"))


def snippet_cards(spark: SparkSession, root: str) -> DataFrame:
    chunks, asked = chunk_table(spark, root), title_queries(spark, root)
    ranked = lexical.TermIndex(chunks).best(asked, 5).join(chunks.select("chunk_id", "source", "title", "body"), "chunk_id").join(asked, "query_id")
    return snippets.cards(ranked, F.col("query")).select("query_id", "rank", "source", "text")


def context_budget(spark: SparkSession, root: str) -> DataFrame:
    chunks = chunk_table(spark, root)
    ranked = lexical.TermIndex(chunks).best(title_queries(spark, root), 10).join(chunks.select("chunk_id", "body"), "chunk_id")
    return snippets.budgeted(ranked, F.length(F.coalesce("body", F.lit(""))), 3000).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.col("used").cast("bigint").alias("used"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_distinct_topk, doc_grouped_search, ngram_jaccard_topk, ngram_jaccard_titles, weighted_fields, weighted_fields_titles, weighted_fields_v2, weighted_fields_v2_titles, document_scores, ticket_search, knn_cosine, knn_cells, knn_metrics, hybrid_blend, mode_bm25_only, mode_ngram_only, mode_vector_only, nearest_chunks, hybrid_vectors, hybrid_hash_vectors, stored_search, stored_vectors, v2_blend, v2_vectors, rrf_fusion, candidate_provenance, eval_modes, eval_complement, eval_recall, snippet_cards, context_budget)}

_ASKED = "asked as (select idx as query_id, min(title) as query from maintenance_requests where idx % 20 = 0 and title is not null group by idx)"


def _bm25(name: str, text: str, asked: str = "asked", k1: float = 1.5, b: float = 0.75) -> str:
    return f"""{name}_tok as (select chunk_id, {sql.bm25_tokens(text)} as tokens from chunks),
{name}_post as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, len(tokens) as dl, unnest(tokens) as term from {name}_tok) group by all),
{name}_df as (select term, count(*) as df from {name}_post group by term),
{name}_n as (select count(*) as n, avg(len(tokens)) as avgdl from {name}_tok),
{name}_q as (select query_id, term, count(*) as qtf from (select query_id, unnest({sql.bm25_tokens("query")}) as term from {asked}) group by all),
{name} as (select query_id, chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) as score
  from {name}_q join {name}_post using (term) join {name}_df using (term), {name}_n group by all)"""


def _top(name: str, k: int) -> str:
    return f"(select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from {name} qualify rank <= {k})"


_TEXT_QUERY = " ".join([plain.normalize(QUERY), *plain.expansion(QUERY, SYNONYMS)])
_GRAMS = "[" + ", ".join(sql.lit(g) for g in sorted(plain.ngram_set(QUERY))) + "]"
_MORE_GRAMS = "[" + ", ".join(sql.lit(g) for g in sorted(plain.ngram_set(_TEXT_QUERY))) + "]"


def _jaccard(grams: str, text: str, rows: str = "chunks") -> str:
    return f"(select chunk_id, len(list_intersect(own, {grams})) / (len(own) + len({grams}) - len(list_intersect(own, {grams}))) as ngram from {sql.ngram_sets(text, rows)})"


def _fields(weights: dict[str, int], terms: list[str] | None = None) -> str:
    parts = []
    for t in plain.search_terms(QUERY) if terms is None else terms:
        for f, w in weights.items():
            e = sql.normalized("body") if f == "normalized_body" else f"lower(coalesce({f}, ''))"
            parts.append(f"case when contains({e}, {sql.lit(t)}) then {w} else 0 end")
    return " + ".join(parts)


def _weighted(weights: dict[str, int], terms: list[str] | None = None, limit: int = 50) -> str:
    return f"select chunk_id, cast(match_score as bigint) as match_score from (select chunk_id, source, try_cast(updated_at as timestamptz) as u, {_fields(weights, terms)} as match_score from chunks where source in (select source from maintenance_docs where deleted_at is null)) where match_score > 0 order by match_score desc, u desc nulls last, source, chunk_id limit {limit}"


def _weighted_many(weights: dict[str, int]) -> str:
    terms = f"list_distinct(list_filter(list_transform({sql.words('query')}, lambda w: {sql.without_particle('w')}), lambda t: (length(t) >= 2 or regexp_full_match(t, '[0-9]+')) and t not in ({', '.join(map(sql.lit, tx.SEARCH_STOPWORDS))})))"
    worth = " + ".join(f"case when contains({'nb' if f == 'normalized_body' else f'lower(coalesce({f}, $$$$))'}, term) then {w} else 0 end" for f, w in weights.items())
    return f"""with {_ASKED}, q as (select query_id, unnest({terms}) as term from asked), t as (select distinct term from q),
c as materialized (select *, {sql.normalized("body")} as nb, try_cast(updated_at as timestamptz) as u from chunks where source in (select source from maintenance_docs where deleted_at is null)),
h as (select chunk_id, source, u, term, {worth} as worth from c, t),
s as (select query_id, chunk_id, any_value(source) as source, any_value(u) as u, sum(worth) as match_score from q join h using (term) where worth > 0 group by all)
select query_id, chunk_id, cast(match_score as bigint) as match_score, row_number() over (partition by query_id order by match_score desc, u desc nulls last, source, chunk_id) as rank from s qualify rank <= 50"""


_FORM = {f: sql.normalized(f) for f in ("title", "filename", "folder", "heading", "body")}
_CFG = DEFAULTS["search"]


def _boosts(terms: list[str] | None = None) -> str:
    own, more = tuple(sorted(set(plain.words(QUERY) if terms is None else terms))), tuple(plain.expansion(QUERY, SYNONYMS))
    field = " + ".join(f"case when {sql.any_of('f_' + f, own)} then {w} when {sql.any_of('f_' + f, more)} then {w * _CFG['expanded_share']} else 0 end" for f, w in _CFG["field_boosts"].items())
    joined = "concat_ws(' ', " + ", ".join("f_" + f for f in _FORM) + ")"
    exact = f"case when contains({joined}, {sql.lit(plain.normalize(QUERY))}) then {_CFG['exact_phrase_boost']} else 0 end + case when contains(replace({joined}, ' ', ''), {sql.lit(plain.compact(QUERY))}) then {_CFG['compact_exact_phrase_boost']} else 0 end"
    recency = f"coalesce(greatest(0.0, 0.05 * (1 - least(greatest(0.0, (epoch_us(timestamptz '{AS_OF}+00') - epoch_us(try_cast(updated_at as timestamptz))) / 86400000000.0), 365.0) / 365.0)), 0.0)"
    recency = f"case when try_cast(updated_at as timestamptz) is null then 0.0 else {recency} end"
    return f"least({field}, {_CFG['field_boost_cap']}) as field_boost, least({exact}, {_CFG['exact_boost_cap']}) as exact_match_boost, {recency} as recency_boost"


_VECTORS = f"""asked_v as (select embedding::double[] as e from embeddings where vec_id = {ASKED_VECTOR}),
sim as (select chunk_id, greatest(0.0, least(1.0, list_cosine_similarity(embedding::double[], e))) as similarity from chunks join embeddings on vec_id = ('0x' || left(md5(chunk_id), 7))::bigint % {PLACES}, asked_v),
near as (select * from sim order by round(similarity, 9) desc, chunk_id limit 50)"""
_NO_VECTORS = "sim as (select null::varchar as chunk_id, null::double as similarity where false), near as (select * from sim)"


def _mode(mode: str, vectors: bool = False) -> str:
    chosen = {"hybrid": "select chunk_id from cand order by round(bm25 * 0.35 + ngram * 0.15 + coalesce(near, 0) * 0.35, 9) desc, chunk_id limit 100", "bm25_only": "select chunk_id from cand where in_b", "ngram_only": "select chunk_id from cand where in_g", "vector_only": "select chunk_id from cand where near is not null"}[mode]
    rank = {"hybrid": "final", "bm25_only": "bm25", "ngram_only": "ngram", "vector_only": "embedding"}[mode]
    return f"""with one as (select 0 as query_id, {sql.lit(_TEXT_QUERY)} as query),
{_VECTORS if vectors else _NO_VECTORS},
{_bm25("b", sql.SEARCHED, "one")},
g as {_jaccard(_MORE_GRAMS, sql.SEARCHED)},
al as (select c.chunk_id, coalesce(b.score, 0) as raw, g.ngram from chunks c left join b using (chunk_id) join g using (chunk_id)),
s as (select chunk_id, raw / (select case when max(raw) > 0 then max(raw) else 1 end from al) as bm25, ngram from al),
r as (select *, row_number() over (order by round(bm25, 9) desc, chunk_id) <= 50 as in_b, row_number() over (order by round(ngram, 9) desc, chunk_id) <= 50 as in_g from s),
cand as (select r.*, near.similarity as near from r left join near using (chunk_id) where in_b or in_g or near.similarity is not null),
f as (select chunk_id, updated_at, {", ".join(f"{e} as f_{n}" for n, e in _FORM.items())} from chunks where chunk_id in ({chosen})),
p as (select f.*, cand.* exclude (chunk_id), coalesce(near, sim.similarity, 0.0)::double as embedding, {_boosts()} from f join cand using (chunk_id) left join sim using (chunk_id)),
t as (select *, bm25 * 0.35 + ngram * 0.15 + embedding * 0.35 + field_boost * 0.10 + exact_match_boost * 0.05 + recency_boost as final from p)
select chunk_id, round(bm25, 6) as bm25, round(ngram, 6) as ngram, round(embedding, 6) as embedding, round(field_boost::double, 6) as field_boost, round(exact_match_boost::double, 6) as exact_match_boost, round(recency_boost, 6) as recency_boost, round({rank}, 6) as score,
  concat_ws('+', case when in_b then 'bm25' end, case when in_g then 'ngram' end, case when near is not null then 'vector' end) as sources from t where {rank} > 0 order by round({rank}, 9) desc, chunk_id limit 20"""


def _stored_sql(vectors: bool) -> str:
    terms = plain.search_terms(_TEXT_QUERY)
    flat = r"trim(regexp_replace(" + sql.strip(r"replace(body, chr(65279), '')") + r", '(?:\s|\p{Z})+', ' ', 'g'))"
    focus = sql.strip(f"case when length(flat) <= 1800 then flat else substring(flat, cast(greatest(1, coalesce({_POS} - 250, 1)) as int), 1800) end")
    embedding = "similarity" if vectors else "case when raw > 0 then similarity else 0.0 end"
    kept = "true" if vectors else "(raw > 0 or field_boost > 0 or exact_match_boost > 0)"
    return f"""with {_VECTORS if vectors else _NO_VECTORS},
h as ({_weighted(lexical.FIELD_WEIGHTS, terms, 160)}),
hv as (select chunk_id, coalesce(match_score, 0)::double as raw, coalesce(similarity, 0.0) as similarity from h full join near using (chunk_id)),
x as (select c.* exclude (body), raw, similarity, {flat} as flat from chunks c join hv using (chunk_id) where source in (select source from maintenance_docs where deleted_at is null)),
rows_ as materialized (select * exclude (flat), {focus} as body from x where flat <> ''),
g as {_jaccard(_MORE_GRAMS, sql.SEARCHED, "rows_")},
f as (select chunk_id, source, updated_at, raw, similarity, raw / (select case when max(raw) > 0 then max(raw) else 1 end from rows_) as bm25, ngram, {", ".join(f"{e} as f_{n}" for n, e in _FORM.items())} from rows_ join g using (chunk_id)),
p as (select *, {embedding} as embedding, {_boosts(plain.search_terms(QUERY))} from f),
t as (select *, bm25 * 0.35 + ngram * 0.15 + embedding * 0.35 + field_boost * 0.10 + exact_match_boost * 0.05 + recency_boost as final from p where {kept})
select chunk_id, source, round(final, 6) as score from t where final > 0 order by round(final, 9) desc, chunk_id limit 20"""


def _v2_sql(vectors: bool) -> str:
    return f"""with {_VECTORS if vectors else _NO_VECTORS}, h as ({_weighted(lexical.FIELD_WEIGHTS_V2)}),
hv as (select chunk_id, coalesce(match_score, 0)::double as ms, coalesce(similarity, 0.0) as vector from h full join near using (chunk_id)),
g as {_jaccard(_GRAMS, _V2_TEXT)},
x as (select c.chunk_id, hv.ms / (select case when max(ms) > 0 then max(ms) else 1 end from hv) as lexical, vector, g.ngram, c.updated_at, {sql.normalized(_V2_TEXT)} as form from chunks c join hv using (chunk_id) join g using (chunk_id) where source in (select source from maintenance_docs where deleted_at is null)),
y as (select *, case when {sql.any_of("form", tuple(plain.search_terms(QUERY)))} then 1.0 else 0.0 end as hit, case when try_cast(updated_at as timestamptz) is null then 0.0 else greatest(0.0, 0.05 * (1 - least(greatest(0.0, (epoch_us(timestamptz '{AS_OF}+00') - epoch_us(try_cast(updated_at as timestamptz))) / 86400000000.0), 365.0) / 365.0)) end as recency from x),
z as (select *, lexical * 0.45 + vector * 0.30 + hit * 0.15 + ngram * 0.05 + recency as score from y where lexical > 0 or hit > 0 or vector <> 0)
select chunk_id, round(lexical, 6) as lexical, {"round(vector, 6) as vector, " if vectors else ""}round(ngram, 6) as ngram, round(score, 6) as score from z order by round(score, 9) desc, chunk_id limit 20"""


_V2_TEXT = "concat_ws(chr(10), coalesce(title, ''), coalesce(folder, ''), coalesce(heading, ''), coalesce(source, ''), coalesce(body, ''))"
_SIMS = "sims as (select a.vec_id as query_id, b.vec_id as id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), near as (select *, row_number() over (partition by query_id order by round(similarity, 9) desc, id) as rank from sims qualify rank <= 10)"
_RUN_SQL = f"""{_ASKED}, {_bm25("bb", "coalesce(body, '')")}, {_bm25("hh", "concat_ws(chr(10), coalesce(title, ''), coalesce(heading, ''))")},
runs as (select query_id, chunk_id, 'body' as run, rank, 1.0 as w from {_top("bb", 30)} union all select query_id, chunk_id, 'head', rank, 1.2 from {_top("hh", 20)})"""
_LEMMAS = "flatten(list_transform(list_filter(regexp_extract_all(lower({}), '[가-힣]+|[a-z][a-z0-9_.-]*|[0-9]+'), lambda w: length(w) >= 2 and w not in (" + ", ".join(map(sql.lit, tx.LEMMA_STOPWORDS)) + ")), lambda w: case when regexp_full_match(w, '[가-힣]+') and length(w) > 3 then list_concat([w], [substring(w, i, 2) for i in range(1, length(w))]) else [w] end))"
_LEMMA_SQL = f"""with {_ASKED}, tok as (select chunk_id, length(coalesce(body, '')) / 3.0 as bl, {_LEMMAS.format("coalesce(body, '') || ' ' || coalesce(heading, '') || ' ' || coalesce(title, '')")} as tokens from chunks),
post as (select chunk_id, term, count(*) as tf, any_value(dl) as dl from (select chunk_id, length(array_to_string(tokens, ' ')) / 3.0 as dl, unnest(tokens) as term from tok) group by all),
df as (select term, count(*) as df from post group by term), n as (select count(*) as n, greatest(avg(bl), 1.0) as avgdl from tok),
q as (select distinct query_id, unnest({_LEMMAS.format("query")}) as term from asked),
lem as (select query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from q join post using (term) join df using (term), n group by all)"""
_FOCUS_WORDS = [w.lower() for w in QUERY.split() if len(w) >= 2]
_FLAT = r"trim(regexp_replace(" + sql.strip(r"replace(content, chr(65279), '')") + r", '(?:\s|\p{Z})+', ' ', 'g'))"
_POS = "least(" + ", ".join(f"case when strpos(lower(flat), {sql.lit(w)}) > 0 then strpos(lower(flat), {sql.lit(w)}) end" for w in _FOCUS_WORDS) + ")"
_DOC_WORDS = plain.words(QUERY)

_CASES = f"{sql.LIVE}, cases as (select doc_pk as query_id, title as query, source as want from live where doc_pk % 20 = 0 and title is not null)"
_JUDGED = f"""with {_CASES}, {_bm25("b", sql.SEARCHED, "cases")},
gc as (select chunk_id, len(own) as n, unnest(own) as g from {sql.ngram_sets(sql.SEARCHED)}),
gq as (select chunk_id as query_id, len(own) as m, unnest(own) as g from {sql.ngram_sets("query", "(select query_id as chunk_id, query from cases)")}),
gs as (select query_id, chunk_id, count(*) / (any_value(n) + any_value(m) - count(*)) as score from gq join gc using (g) group by query_id, chunk_id),
runs as (select 'bm25' as mode, query_id, chunk_id, rank from {_top("b", 10)} union all select 'ngram', query_id, chunk_id, rank from {_top("gs", 10)}),
first as (select mode, query_id, min(rank) as r from runs join chunks using (chunk_id) join cases using (query_id) where source = want group by all)"""

SQL = {
    "eval_modes": _JUDGED + """, j as (select m.mode, cases.query_id, r from (values ('bm25'), ('ngram')) m(mode) left join cases on true left join first on first.mode = m.mode and first.query_id = cases.query_id)
select mode, count(query_id) as n, round(coalesce(avg(case when r <= 1 then 1.0 else 0 end) filter (query_id is not null), 0), 6) as hit_1, round(coalesce(avg(case when r <= 3 then 1.0 else 0 end) filter (query_id is not null), 0), 6) as hit_3,
  round(coalesce(avg(case when r <= 5 then 1.0 else 0 end) filter (query_id is not null), 0), 6) as hit_5, round(coalesce(avg(coalesce(1.0 / r, 0)) filter (query_id is not null), 0), 6) as mrr from j group by mode""",
    "eval_complement": _JUDGED + """, s as (select query_id, bool_or(mode = 'bm25') as a, bool_or(mode = 'ngram') as b from first where r <= 5 group by query_id)
select case when a and b then 'both' when a then 'a only' else 'b only' end as solved_by, count(*) as n from s group by 1""",
    "eval_recall": _JUDGED + """, w as (select query_id, chunk_id from cases join chunks on source = want)
select round(avg(x), 6) as recall from (select w.query_id, avg(case when runs.chunk_id is not null then 1.0 else 0 end) as x from w left join runs on runs.mode = 'bm25' and runs.query_id = w.query_id and runs.chunk_id = w.chunk_id group by w.query_id)""",
    "bm25_topk": f"with {_ASKED}, {_bm25('b', sql.SEARCHED)} select query_id, chunk_id, round(score, 6) as score, rank from {_top('b', 10)}",
    "doc_grouped_search": f"""with {_ASKED}, {_bm25("b", sql.SEARCHED)}, k as (select x.*, c.document_id from {_top("b", 20)} x join chunks c using (chunk_id)),
d as (select query_id, document_id, arg_min(chunk_id, rank) as chunk_id, round(arg_min(score, rank), 4) as score, min(rank) as first_rank, list(chunk_id order by rank) as l from k group by all)
select query_id, document_id, chunk_id, score, row_number() over (partition by query_id order by first_rank) as rank, array_to_string(l[2:], ',') as related from d qualify rank <= 5""",
    "ngram_jaccard_topk": f"select chunk_id, round(ngram, 6) as score from {_jaccard(_GRAMS, sql.SEARCHED)} order by round(ngram, 9) desc, chunk_id limit 20",
    "ngram_jaccard_titles": f"""with {_ASKED}, c as (select chunk_id, len(own) as n, unnest(own) as g from {sql.ngram_sets(sql.SEARCHED)}),
q as (select chunk_id as query_id, len(own) as m, unnest(own) as g from {sql.ngram_sets("query", "(select query_id as chunk_id, query from asked)")}),
s as (select query_id, chunk_id, count(*) / (any_value(n) + any_value(m) - count(*)) as score from q join c using (g) group by query_id, chunk_id)
select query_id, chunk_id, round(score, 6) as score, rank from {_top("s", 20)}""",
    "weighted_fields_titles": _weighted_many(lexical.FIELD_WEIGHTS),
    "weighted_fields_v2_titles": _weighted_many(lexical.FIELD_WEIGHTS_V2),
    "weighted_fields": _weighted(lexical.FIELD_WEIGHTS),
    "weighted_fields_v2": _weighted(lexical.FIELD_WEIGHTS_V2),
    "document_scores": f"""with {sql.LIVE}, x as (select *, {_FLAT} as flat from live where content is not null),
y as (select *, {sql.normalized("title")} as t, {sql.normalized("source")} as s, {sql.normalized("customer")} as c,
  {sql.normalized(f"case when length(flat) <= 1800 then flat else substring(flat, cast(greatest(1, coalesce({_POS} - 250, 1)) as int), 1800) end")} as b from x where flat <> '')
select source, cast(score as double) as score from (select source, case when contains(t, {sql.lit(plain.normalize(QUERY))}) then 20.0 else 0.0 end + {" + ".join(f"case when contains({e}, {sql.lit(w)}) then {v} else 0 end" for w in _DOC_WORDS for e, v in (("t", 6), ("s", 3), ("c", 3), ("b", 1)))} as score from y) where score > 0""",
    "ticket_search": r"""with one as (select distinct on (idx) * from maintenance_requests order by idx, imported_at desc nulls last, last_import_id desc nulls last),
t as (select *, trim(regexp_replace(concat_ws(chr(10), idx::varchar, user_id, title, report_title, notes), '(?:\s|\p{Z})+', ' ', 'g')) as search_text from one),
m as (select * from t where search_text ilike '%점검%' and search_text ilike '%요청%' order by updated_at desc nulls last, request_date desc nulls last, idx desc limit 500)
select idx, cast(score as bigint) as score from (select *, case when contains(lower(coalesce(title, '')), '점검 요청') then 20 when contains(lower(search_text), '점검 요청') then 10 else 0 end
  + case when contains(lower(coalesce(title, '')), '점검') then 5 else 0 end + case when contains(lower(coalesce(user_id, '')), '점검') then 3 else 0 end + case when contains(lower(search_text), '점검') then 1 else 0 end
  + case when contains(lower(coalesce(title, '')), '요청') then 5 else 0 end + case when contains(lower(coalesce(user_id, '')), '요청') then 3 else 0 end + case when contains(lower(search_text), '요청') then 1 else 0 end as score
from m) order by score desc, updated_at desc nulls last, idx desc limit 50""",
    "knn_cosine": f"with {_SIMS} select query_id, id, round(similarity, 6) as similarity, rank from near",
    "knn_cells": f"with {_SIMS} select query_id, id, round(similarity, 6) as similarity, rank from near",
    "knn_metrics": f"""with {_SIMS}, first as (select n.query_id, min(rank) as r from near n join embeddings a on a.vec_id = n.query_id join embeddings b on b.vec_id = n.id where a.label = b.label group by 1),
c as (select vec_id as query_id, r from embeddings left join first on first.query_id = vec_id where vec_id % 20 = 0)
select count(*) as n, round(avg(case when r <= 1 then 1.0 else 0 end), 6) as hit_1, round(avg(case when r <= 3 then 1.0 else 0 end), 6) as hit_3, round(avg(case when r <= 5 then 1.0 else 0 end), 6) as hit_5, round(avg(coalesce(1.0 / r, 0)), 6) as mrr from c""",
    "hybrid_blend": _mode("hybrid"),
    "mode_bm25_only": _mode("bm25_only"),
    "mode_ngram_only": _mode("ngram_only"),
    "v2_blend": _v2_sql(False),
    "v2_vectors": _v2_sql(True),
    "mode_vector_only": _mode("vector_only", True),
    "hybrid_vectors": _mode("hybrid", True),
    "nearest_chunks": f"with {_VECTORS} select chunk_id, round(similarity, 6) as similarity from near",
    "stored_search": _stored_sql(False),
    "stored_vectors": _stored_sql(True),
    "bm25_distinct_topk": _LEMMA_SQL + f" select query_id, chunk_id, round(score, 6) as score, rank from {_top('lem', 10)}",
    "rrf_fusion": f"""with {_RUN_SQL}, u as (select query_id, chunk_id, sum(w / (60 + rank)) as score, string_agg(run, '+' order by run) as via from runs group by all)
select query_id, chunk_id, round(score, 6) as score, via, rank from {_top("u", 10)}""",
    "candidate_provenance": f"with {_RUN_SQL} select query_id, chunk_id, string_agg(run, '+' order by run) as sources from runs group by all",
    "context_budget": f"""with {_ASKED}, {_bm25("b", sql.SEARCHED)}, k as (select x.query_id, x.chunk_id, x.rank, sum(length(coalesce(c.body, ''))) over (partition by query_id order by rank) as used from {_top("b", 10)} x join chunks c using (chunk_id))
select query_id, chunk_id, rank, cast(used as bigint) as used from k where used <= 3000""",
}
