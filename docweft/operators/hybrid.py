"""Blended ranking of chunks: words, n-grams, vectors, fields, exact phrases and recency.

Candidates come from short ranked lists, and only these are scored in full. Chunks have chunk_id,
document_id, source, title, filename, folder, heading, body and updated_at (timestamp).
Equal scores go by chunk_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import plain
from docweft.functions import text as tx
from docweft.functions.vectors import clamped, cosine
from docweft.operators import fusion, lexical
from docweft.session import stage
from docweft.settings import DEFAULTS

MODES = ("hybrid", "bm25_only", "ngram_only", "vector_only")
_FIELDS = ("title", "filename", "folder", "heading", "body")


def _has(text: Column, terms: list[str]) -> Column:
    return tx.any_of(text, tuple(t for t in terms if t))


def field_boost(query: str, terms: list[str] | None, synonyms: dict, cfg: dict, forms: dict[str, Column]) -> Column:
    """Sum of the boosts of the fields that hold a term of the query, or less if only a synonym; capped."""
    own = sorted(set(plain.words(query) if terms is None else terms))
    more = plain.expansion(query, synonyms)
    parts = [F.when(_has(forms[f], own), boost).when(_has(forms[f], more), boost * cfg["expanded_share"]).otherwise(0.0) for f, boost in cfg["field_boosts"].items()]
    return F.least(reduce(lambda a, b: a + b, parts), F.lit(cfg["field_boost_cap"]))


def exact_boost(query: str, cfg: dict, forms: dict[str, Column]) -> Column:
    """For the whole query in the joined fields, and in them without blanks; capped."""
    whole, dense = plain.normalize(query), plain.compact(query)
    joined = F.concat_ws(" ", *[forms[f] for f in _FIELDS])
    score = F.when(F.contains(joined, F.lit(whole)), cfg["exact_phrase_boost"]).otherwise(0.0) if whole else F.lit(0.0)
    if len(dense) >= 2:
        score = score + F.when(F.contains(F.replace(F.concat(*[forms[f] for f in _FIELDS]), F.lit(" "), F.lit("")), F.lit(dense)), cfg["compact_exact_phrase_boost"]).otherwise(0.0)
    return F.least(score, F.lit(cfg["exact_boost_cap"]))


def _forms() -> dict[str, Column]:
    return {f: tx.normalized(F.col(f)) for f in _FIELDS}


def _blend(rows: DataFrame, query: str, terms: list[str] | None, settings: dict, as_of: Column) -> DataFrame:
    """`rows` (with bm25, ngram, embedding of 0..1) with the boosts and final_score."""
    cfg, w = settings["search"], settings["search"]["weights"]
    boosted = rows.withColumns({"field_boost": field_boost(query, terms, settings["synonyms"], cfg, _forms()), "exact_match_boost": exact_boost(query, cfg, _forms()), "recency_boost": tx.recency_boost(F.col("updated_at"), as_of, w["recency_boost_max"])})
    total = F.col("bm25") * w["bm25"] + F.col("ngram") * w["ngram"] + F.col("embedding") * w["embedding"] + F.col("field_boost") * w["field_boost"] + F.col("exact_match_boost") * w["exact_match_boost"] + F.col("recency_boost")
    return boosted.withColumn("final_score", total)


def _best(df: DataFrame, score: str | Column, n: int) -> DataFrame:
    return df.orderBy(F.round(F.col(score) if isinstance(score, str) else score, 9).desc(), "chunk_id").limit(n)


def _near(spark: SparkSession, vectors: DataFrame | None, most: int) -> DataFrame:
    """(chunk_id, similarity) of the `most` nearest chunks given."""
    if vectors is None:
        return spark.createDataFrame([], "chunk_id string, similarity double")
    return _best(vectors.select("chunk_id", "similarity"), "similarity", most)


def _similarity(rows: DataFrame, given: str, embeddings: DataFrame | None, query_vector: Sequence[float] | None, embed: Column | None) -> DataFrame:
    """`rows` with embedding: the similarity given, else that of the stored vector, else of one made now, else 0."""
    ways = [F.col(given)]
    if query_vector is not None:
        asked = F.array(*[F.lit(float(x)) for x in query_vector])
        if embeddings is not None:
            # The rows are few, so they go to the vectors and not these to them.
            stored = embeddings.select("chunk_id", F.col("embedding").alias("_stored")).join(F.broadcast(rows.select("chunk_id")), "chunk_id")
            rows = rows.join(stored, "chunk_id", "left")
            ways.append(F.when(F.size("_stored") > 0, clamped(cosine(F.col("_stored"), asked))))
        if embed is not None:
            rows = rows.withColumn("_made", F.when(reduce(lambda a, b: a & b, [w.isNull() for w in ways]), embed))
            ways.append(F.when(F.size("_made") > 0, clamped(cosine(F.col("_made"), asked))))
    return rows.withColumn("embedding", F.coalesce(*ways, F.lit(0.0))).drop("_stored", "_made", *[given] * (given != "embedding"))


def search(chunks: DataFrame, query: str, as_of: Column, top_k: int = 5, mode: str = "hybrid", settings: dict = DEFAULTS, vectors: DataFrame | None = None, embeddings: DataFrame | None = None, query_vector: Sequence[float] | None = None, embed: Column | None = None, index: lexical.TermIndex | None = None, features: DataFrame | None = None) -> DataFrame:
    """The best chunks with all partial scores, sources (which lists had them), score and rank.

    `vectors` has the nearest chunks (chunk_id, similarity). With a `query_vector`, candidates that are not among
    these have the similarity of their stored vector in `embeddings` (chunk_id, embedding), or of what `embed`, a
    column over the chunks, makes. Lists are cut before zero scores are dropped, so chunks without any hit can take
    places. In a single mode only that list is ranked, by its own score. A stored `index` with `features` spares
    the reading of all texts.
    """
    mode = mode if mode in MODES else "hybrid"
    limits, w = settings["search"]["candidate_limits"], settings["search"]["weights"]
    text = " ".join([plain.normalize(query), *plain.expansion(query, settings["synonyms"])])
    one = lexical.OneQuery(chunks, text, index=index, features=features, **settings["bm25"])
    near = _near(chunks.sparkSession, vectors, limits["vector"])
    by_words = _best(one.words, "raw", limits["bm25"]).select("chunk_id")
    if one.n_hits < limits["bm25"]:
        # Chunks without a hit fill the list, by their ids.
        first = one.grams.select("chunk_id").orderBy("chunk_id").limit(2 * limits["bm25"])
        by_words = by_words.union(first.join(one.words.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id").limit(limits["bm25"] - one.n_hits))
    lists = {"bm25": by_words, "ngram": _best(one.grams, "ngram", limits["ngram"]), "vector": near}
    # Bounded by the limits of the three lists.
    found = F.broadcast(fusion.with_provenance({name: df.select("chunk_id", F.lit(0).alias("query_id")) for name, df in lists.items()}).select("chunk_id", "sources"))
    both = one.grams.join(found, "chunk_id").join(near.withColumnRenamed("similarity", "near"), "chunk_id", "left")
    hits = one.words.join(found.select("chunk_id"), "chunk_id")
    candidates = both.join(F.broadcast(hits), "chunk_id", "left").withColumn("bm25", F.coalesce(F.col("raw") / one.most, F.lit(0.0))).drop("raw")
    if mode == "hybrid":
        candidates = _best(candidates, F.col("bm25") * w["bm25"] + F.col("ngram") * w["ngram"] + F.coalesce("near", F.lit(0.0)) * w["embedding"], limits["merged_max"])
    else:
        candidates = candidates.filter(F.array_contains("sources", mode.removesuffix("_only")))
    # Staged, as the candidates are few and each further step would make them anew.
    rows = _similarity(chunks.join(F.broadcast(stage(candidates, "candidates")), "chunk_id"), "near", embeddings, query_vector, embed)
    own = {"bm25_only": "bm25", "ngram_only": "ngram", "vector_only": "embedding"}.get(mode, "final_score")
    ranked = _best(_blend(rows, query, None, settings, as_of).withColumn("score", F.col(own)), "score", top_k).filter("score > 0")
    return fusion.ranked(ranked.withColumn("query_id", F.lit(0)), "score")


def debug_candidates(found: DataFrame, n: int = 10) -> DataFrame:
    """(list, place, chunk_id, title, matched_text, scores): the best `n` of search()'s rows by each of its lists, and in the end."""
    text = F.substring(tx.collapsed(F.coalesce("body", F.lit(""))), 1, 700)
    names = ("bm25", "ngram", "embedding", "field_boost", "exact_match_boost", "recency_boost", "final_score")
    scores = F.create_map(*[x for c in names for x in (F.lit(c), F.round(c, 4))])
    parts = []
    for name, by in (("bm25", "bm25"), ("ngram", "ngram"), ("vector", "embedding"), ("final", "final_score")):
        own = found if name == "final" else found.filter(F.array_contains("sources", name))
        best = fusion.ranked(_best(own, by, n).withColumn("query_id", F.lit(0)).drop("rank"), by)
        parts.append(best.select(F.lit(name).alias("list"), F.col("rank").alias("place"), "chunk_id", "title", text.alias("matched_text"), scores.alias("scores")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def documents(ranked: DataFrame, top_k: int) -> DataFrame:
    """Found chunks grouped to documents, each by its best chunk; the others follow in related."""
    return lexical.grouped_by_document(ranked.select("query_id", "chunk_id", "score", "rank"), ranked, top_k)


def stored_search(chunks: DataFrame, docs: DataFrame, query: str, as_of: Column, top_k: int = 5, settings: dict = DEFAULTS, vectors: DataFrame | None = None, semantic: bool = False) -> DataFrame:
    """Ranking of a stored chunk table: weighted fields for words, and chunks of live documents only.

    With hashed embeddings (`semantic` False) a chunk needs a hit in its words, fields or as a phrase, and
    vectors count only beside one. Where nothing is found, documents are scored instead.
    """
    limit = max(top_k * 8, settings["search"]["candidate_limits"]["bm25"])
    text = " ".join([plain.normalize(query), *plain.expansion(query, settings["synonyms"])]).strip() or query
    live = chunks.join(docs.filter("deleted_at is null").select("source").distinct(), "source", "left_semi")
    hits = lexical.best_fields(lexical.field_scores(live, plain.search_terms(text)), limit).select("chunk_id", F.col("match_score").cast("double").alias("raw"))
    near = _near(chunks.sparkSession, vectors, settings["search"]["candidate_limits"]["vector"])
    both = hits.join(near, "chunk_id", "full").select("chunk_id", F.coalesce("raw", F.lit(0.0)).alias("raw"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    rows = live.join(F.broadcast(both), "chunk_id").withColumn("body", tx.focused(F.lit(query), F.col("body"))).filter("body != ''")
    most = rows.agg(F.max("raw").alias("most"))
    grams = lexical.ngram_scores(lexical.ngram_features(rows), text).withColumnRenamed("score", "ngram")
    scored = rows.join(grams, "chunk_id").join(F.broadcast(most)).withColumn("bm25", F.col("raw") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0))
    embedding = F.col("similarity") if semantic else F.when(F.col("raw") > 0, F.col("similarity")).otherwise(0.0)
    final = _blend(scored.withColumn("embedding", embedding), query, plain.search_terms(query), settings, as_of)
    if not semantic:
        final = final.filter((F.col("raw") > 0) | (F.col("field_boost") > 0) | (F.col("exact_match_boost") > 0))
    found = _best(final.withColumn("score", F.col("final_score")), "score", top_k).filter("score > 0").select("chunk_id", "document_id", "source", "title", "heading", "body", "score")
    if not found.isEmpty():
        return found
    fallback = lexical.document_scores(lexical.any_term(docs.filter("deleted_at is null").dropDuplicates(["source"]), plain.search_terms(query)), query)
    doc_id = tx.document_id(F.col("source"))
    made = fallback.select(F.concat(doc_id, F.lit("_db_0001")).alias("chunk_id"), doc_id.alias("document_id"), "source", "title", F.col("title").alias("heading"), tx.focused(F.lit(query), F.col("content")).alias("body"), "score")
    return made.orderBy(F.desc("score"), "source").limit(top_k).filter("score > 0")


def search_v2(chunks: DataFrame, docs: DataFrame, query: str, as_of: Column, top_k: int = 5, candidate_limit: int = 50, settings: dict = DEFAULTS, vectors: DataFrame | None = None, rerank=None) -> DataFrame:
    """Union of the best chunks by weighted fields and by vector, blended; `rerank` may reorder the first 30.

    `rerank` maps (query, DataFrame) to a DataFrame with the columns given, best first by score.
    """
    w = settings["v2"]
    live = chunks.join(docs.filter("deleted_at is null").select("source").distinct(), "source", "left_semi")
    terms = plain.search_terms(query)
    hits = lexical.best_fields(lexical.field_scores(live, terms, lexical.FIELD_WEIGHTS_V2), candidate_limit).select("chunk_id", F.col("match_score").cast("double").alias("lexical"))
    near = _near(chunks.sparkSession, vectors, candidate_limit).select("chunk_id", F.col("similarity").alias("vector"))
    both = hits.join(near, "chunk_id", "full").na.fill(0.0)
    text = lexical.searchable("title", "folder", "heading", "source", "body")
    rows = live.join(F.broadcast(both), "chunk_id").withColumn("normalized", tx.normalized(text))
    most = rows.agg(F.max("lexical").alias("most"))
    grams = lexical.ngram_scores(lexical.ngram_features(rows, text=text), query).withColumnRenamed("score", "ngram")
    part = rows.join(grams, "chunk_id").join(F.broadcast(most)).withColumn("lexical", F.col("lexical") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)).withColumn("hit", F.when(_has(F.col("normalized"), terms), 1.0).otherwise(0.0))
    gram = F.col("ngram") if terms else F.lit(0.0)
    score = F.col("lexical") * w["lexical"] + F.col("vector") * w["vector"] + F.col("hit") * w["hit"] + gram * w["ngram"] + tx.recency_boost(F.col("updated_at"), as_of, w["recency"])
    kept = part.withColumn("score", score).filter((F.col("lexical") > 0) | (F.col("hit") > 0) | (F.col("vector") != 0))
    pool = _best(kept, "score", max(top_k, min(candidate_limit, 30))).select("chunk_id", "document_id", "source", "title", "heading", "body", "lexical", "vector", "hit", "ngram", "score")
    return _best(rerank(query, pool) if rerank else pool, "score", top_k)


def for_answer(ranked: DataFrame, floor: float = 0.25) -> DataFrame:
    """Ranked chunks without those of low-value titles, and of the rest those of at least `floor` of the best.

    Either filter that would leave nothing is not applied.
    """
    low = tx.is_low_value_title(F.col("title"))
    kept = ranked.withColumn("_low", low)
    some = kept.agg(F.max(~F.col("_low")).alias("_some"))
    kept = kept.join(F.broadcast(some)).filter(~F.col("_some") | ~F.col("_low"))
    best = kept.agg(F.max("score").alias("_best"))
    return kept.join(F.broadcast(best)).filter(F.col("score") >= F.col("_best") * floor).drop("_low", "_some", "_best")
