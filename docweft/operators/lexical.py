"""Term statistics and word-based ranking of chunks.

Statistics are frames that can be written and reused: postings (one row per chunk and term), chunk lengths
and a row of totals. Queries come as (query_id, query); one literal query is a frame of one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweft.functions import plain
from docweft.functions import text as tx
from docweft.operators import scan
from docweft.session import numbered, stage

#: Chunks of a term from which on it is hot, and the most hot terms that are broadcast; both decide how, not what, is scored.
HOT_TERM, MOST_BROADCAST = 10_000, 100_000
SEARCHED = ("title", "heading", "filename", "folder", "source", "body")
#: Between a group and a token, which has no control characters.
_SEP = "\x1f"
_RUN, _LATIN = re.compile("[0-9a-z]{2,}"), re.compile("[0-9a-z]+")
#: Words by which a query asks for reports or for access, and words of texts about access.
REPORT_WORDS = ("보고서", "월간", "내역서", "점검대장")
ACCESS_ASKED = ("접속정보", "접속", "계정", "로그인", "서버", "경로")
ACCESS_WORDS = ("접속", "계정", "로그인", "관리자", "vpn", "ftp", "id", "pw", "password", "host", "클라우드", "경로")
#: What a term found in a field is worth.
FIELD_WEIGHTS = {"title": 8, "filename": 6, "folder": 6, "heading": 5, "source": 4, "normalized_body": 2, "body": 1}
FIELD_WEIGHTS_V2 = {"title": 12, "filename": 8, "folder": 8, "heading": 6, "source": 5, "normalized_body": 2, "body": 1}


def query_frame(spark: SparkSession, *queries: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")


def searchable(*fields: str) -> Column:
    """The fields as one text."""
    return F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


class TermIndex:
    """Postings and totals of chunks, for BM25 ranking.

    `chunks` has `key` and the searched fields. Chunks without tokens count in the number of chunks and the
    mean length. Keys are taken to be unique; null fields are as empty. `length` makes a chunk's length of its
    tokens; the mean is that of these lengths, or of `mean_of` where given, but then at least 1.
    """

    def __init__(self, chunks: DataFrame, key: str = "chunk_id", text: Column | None = None, tokens=tx.bm25_tokens, length=F.size, mean_of: Column | None = None) -> None:
        self.key = key
        # Staged, as postings, frequencies and totals all come from the tokens, which are costly to make.
        tokenised = stage(chunks.select(F.col(key).alias("chunk_id"), tokens(searchable(*SEARCHED) if text is None else text).alias("tokens"), (F.lit(None).cast("double") if mean_of is None else mean_of).alias("mean_of")), "tokens")
        self._tokens = tokenised.select("chunk_id", length("tokens").alias("dl"), "tokens")
        self.lengths = self._tokens.drop("tokens")
        self.postings = tokenised.select("chunk_id", length("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
        mean = F.avg("dl") if mean_of is None else F.greatest(F.avg("mean_of"), F.lit(1.0))
        self.totals = tokenised.select(length("tokens").alias("dl"), "mean_of").agg(F.count("*").alias("n"), mean.alias("avgdl"))

    def write(self, path: str) -> None:
        """Stores the index below `path`; postings are sorted by term, so that a reader skips what it needs not."""
        self.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")
        self.totals.write.parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TermIndex:
        """The index stored below `path`."""
        made = cls.__new__(cls)
        made.key, made._tokens = "chunk_id", None
        made.postings, made.lengths, made.totals = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "totals"))
        return made

    def scores_of(self, query: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """scores() of one literal query; its terms are pushed down into the scan of stored postings."""
        terms = sorted(set(plain.bm25_tokens(query)))
        own = self.postings.filter(F.col("term").isin(terms)) if terms else self.postings.filter("false")
        return self._sum(own, self._asked(query_frame(self.postings.sparkSession, query), tx.bm25_tokens, True), k1, b, "query_id")

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75, tokens=tx.bm25_tokens, repeated: bool = True, counted: bool = False) -> DataFrame:
        """(query_id, chunk_id, score) of the chunks that share a token with a query; n_terms too if `counted`, how many.

        A token that a query repeats counts each time, unless `repeated` is False. The terms of all queries
        are joined to the postings on the term, so that only their postings are read further.
        """
        asked = self._asked(queries, tokens, repeated)
        return self._sum(self._wanted(asked), asked, k1, b, "query_id", counted)

    @staticmethod
    def _asked(queries: DataFrame, tokens, repeated: bool) -> DataFrame:
        """(query_id, term, qtf) of queries."""
        times = F.count("*") if repeated else F.lit(1)
        return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(times.cast("double").alias("qtf"))

    def _wanted(self, asked: DataFrame) -> DataFrame:
        """The postings of the terms asked for. Terms go to the chunks, unless they are too many to be broadcast."""
        terms = stage(asked.select("term").distinct(), "terms")
        terms = F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms
        if self._tokens is None:
            return stage(self.postings.join(terms, "term").select("chunk_id", "term", "tf", "dl"), "wanted")
        own = self._tokens.select("chunk_id", "dl", F.explode("tokens").alias("term")).join(terms, "term")
        return stage(own.groupBy("chunk_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "wanted")

    def best(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, tokens=tx.bm25_tokens, repeated: bool = True, hot: int = HOT_TERM) -> DataFrame:
        """top_k() of scores(), without multiplying the postings of terms in over `hot` chunks by all queries that have them.

        The other terms are scored first. What hot ones can add to a query's scores has a bound, so that only chunks
        near its best k can still get there; these alone meet the postings of hot terms, by chunk. Queries whose
        hot terms could bring in a chunk by themselves are scored in full, each set of terms once.
        """
        asked = self._asked(queries, tokens, repeated)
        postings = self._wanted(asked)
        common = postings.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") > hot)
        common = stage(common.join(F.broadcast(self.totals)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf")), "hot-terms")
        if common.isEmpty():
            return top_k(self._sum(postings, asked, k1, b, "query_id"), k)
        # Queries of the same terms are one.
        sets = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "qtf"))).alias("terms")).withColumn("set_id", F.xxhash64(F.to_json("terms")))
        sets = stage(sets, "sets")
        once = sets.groupBy("set_id").agg(F.first("terms").alias("terms")).select("set_id", F.inline("terms"))
        once = stage(once.join(common, "term", "left"), "asked-once")
        bound = once.filter("idf is not null").groupBy("set_id").agg(F.sum(F.col("qtf") * F.col("idf") * (k1 + 1.0)).alias("more"))
        rare = stage(self._sum(postings, once.filter("idf is null").select("set_id", "term", "qtf"), k1, b, "set_id"), "rare-scores")
        place = F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score")))
        last = rare.withColumn("place", place).filter(F.col("place") == k).select("set_id", F.col("score").alias("last"))
        limits = stage(once.select("set_id").distinct().join(bound, "set_id", "left").join(last, "set_id", "left").select("set_id", F.coalesce("more", F.lit(0.0)).alias("more"), "last"), "limits")
        closed = limits.filter(F.col("last").isNotNull() & (F.col("last") > F.col("more") + 1e-6))
        near = rare.join(closed, "set_id").filter(F.col("score") + F.col("more") >= F.col("last") - 1e-6).select("set_id", "chunk_id", "score")
        wanted = near.join(once.filter("idf is not null").select("set_id", "term", "qtf", "idf"), "set_id")
        added = wanted.join(postings, ["chunk_id", "term"]).join(F.broadcast(self.totals))
        more = added.select("set_id", "chunk_id", (F.col("qtf") * F.col("idf") * self._share(k1, b)).alias("score"))
        whole = near.unionByName(more).groupBy("set_id", "chunk_id").agg(F.sum("score").alias("score"))
        rest = self._sum(postings, once.join(closed.select("set_id"), "set_id", "left_anti").select("set_id", "term", "qtf"), k1, b, "set_id")
        found = stage(top_k(whole.unionByName(rest), k, by="set_id"), "best")
        return sets.select("query_id", "set_id").join(found, "set_id").select("query_id", "chunk_id", "score", "rank")

    def scanned(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, tokens=tx.bm25_tokens, repeated: bool = True) -> DataFrame:
        """top_k() of scores() by scans of the chunks' tokens: no posting is multiplied by the queries that have it, hot or not."""
        if self._tokens is None:
            return top_k(self.scores(queries, k1, b, tokens, repeated), k)

        def part(asked: scan.Asked) -> DataFrame:
            own = stage(scan.matched(self._tokens, asked.vocabulary), "matched")
            df = np.zeros(len(asked.vocabulary))
            for r in own.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
                df[r.t] = r["count"]
            n, mean = self.totals.select("n", "avgdl").first()
            idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
            asked.weights *= idf[asked.terms]
            mean = max(float(mean or 0.0), 1e-9)
            share = lambda tf, dl: tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / mean))
            return scan.best(own, ["chunk_id"], asked, k, _stored, share)

        return scan.best_of_all(self._asked(queries, tokens, repeated), ["chunk_id"], k, part, "best")

    def counted_within(self, queries: DataFrame, groups: DataFrame, scope: DataFrame, k: int, tokens=tx.bm25_tokens) -> DataFrame:
        """(query_id, chunk_id, score, rank): the best `k` chunks by how many of a query's tokens they have, by scans.

        Only chunks of the groups (chunk_id, grp) that `scope` (query_id, grp) gives the query; equal numbers go by chunk_id.
        """
        asked = self._asked(queries.join(scope, "query_id", "left_semi"), tokens, False).join(scope, "query_id")
        asked = asked.select("query_id", F.concat("grp", F.lit(_SEP), "term").alias("term"), F.lit(1.0).alias("qtf")).distinct()
        held = self.postings.groupBy("chunk_id").agg(F.collect_set("term").alias("tokens")) if self._tokens is None else self._tokens
        own = groups.join(scope.select("grp").distinct(), "grp", "left_semi").join(held.select("chunk_id", "tokens"), "chunk_id").select("chunk_id", "grp", "tokens")
        return scan.best_of_all(asked, ["chunk_id"], k, lambda part: scan.best(own, ["chunk_id"], part, k, _within()), "best")

    @staticmethod
    def _share(k1: float, b: float) -> Column:
        return F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))))

    def _sum(self, postings: DataFrame, asked: DataFrame, k1: float, b: float, by: str, counted: bool = False) -> DataFrame:
        """(`by`, chunk_id, score) of terms asked for (`by`, term, qtf), from all their postings; n_terms too if `counted`."""
        hits = postings.join(postings.groupBy("term").agg(F.count("*").alias("df")), "term").join(F.broadcast(self.totals))  # one row of totals
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        worth = hits.select("term", "chunk_id", (idf * self._share(k1, b)).alias("part"))
        return worth.join(asked, "term").groupBy(by, "chunk_id").agg(F.sum(F.col("qtf") * F.col("part")).alias("score"), *[F.count("*").alias("n_terms")] * counted)


def _stored(batch: pa.RecordBatch, _place: dict) -> scan.Found:
    """What scan.matched() has found."""
    sizes, terms = scan.flat_list(batch.column(2))
    return scan.Found([batch.column(0)], sizes, np.asarray(terms), np.asarray(scan.flat_list(batch.column(3))[1]), np.asarray(batch.column(1)))


def _within() -> Callable[[pa.RecordBatch, dict], scan.Found]:
    """The distinct tokens asked for of a chunk's own group; terms are group and token."""
    known: dict[str, dict[str, int]] = {}

    def found(batch: pa.RecordBatch, place: dict) -> scan.Found:
        if not known:
            for key, i in place.items():
                group, _, token = key.rpartition(_SEP)
                known.setdefault(group, {})[token] = i
        sizes, terms = [], []
        for group, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            of = known.get(group, {})
            hits = [of[t] for t in of.keys() & set(tokens or ())]
            terms += hits
            sizes.append(len(hits))
        return scan.Found([batch.column(0)], np.array(sizes, np.int64), np.array(terms, np.int32), np.ones(len(terms), np.int8), np.zeros(len(sizes)))

    return found


def top_k(scores: DataFrame, k: int, key: str = "chunk_id", by: str = "query_id", score: str = "score") -> DataFrame:
    """The best `k` rows of each query with their rank; equal scores go by key.

    Scores are compared rounded to 9 places, so that the order of summing does not part equal ones.
    """
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def grouped_by_document(ranked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The best `k` documents of ranked chunks (query_id, chunk_id, score, rank).

    A document has the score of its best chunk, which stands for it; its other chunks follow in related.
    """
    known = ranked.join(chunks.select("chunk_id", "document_id", "source", "title", "heading"), "chunk_id")
    one = F.struct("rank", "chunk_id", "score", "heading", "source", "title")
    docs = known.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(one)).alias("found"))
    best = F.col("found")[0]
    flat = docs.select("query_id", "document_id", best["source"].alias("source"), best["title"].alias("title"), best["heading"].alias("heading"), best["chunk_id"].alias("chunk_id"), F.round(best["score"], 4).alias("score"), best["rank"].alias("first_rank"), F.transform(F.slice("found", F.lit(2), F.size("found")), lambda x: x["chunk_id"]).alias("related"))
    place = Window.partitionBy("query_id").orderBy("first_rank")
    return flat.withColumn("rank", F.row_number().over(place).cast("bigint")).filter(F.col("rank") <= k).drop("first_rank")


def ngram_features(chunks: DataFrame, key: str = "chunk_id", text: Column | None = None, tokens: bool = False) -> DataFrame:
    """What n-gram overlap needs of a chunk: its compact form, Hangul, runs and the size of its gram set; its tokens if wanted."""
    body = searchable(*SEARCHED) if text is None else text
    form = chunks.select(F.col(key).alias("chunk_id"), tx.normalized(body).alias("form"))
    dense = F.replace("form", F.lit(" "), F.lit(""))
    return form.select("chunk_id", dense.alias("dense"), F.regexp_replace(dense, "[0-9a-z]+", "").alias("hangul"), F.array_distinct(F.regexp_extract_all("form", F.lit("([0-9a-z]{2,})"))).alias("runs"), F.size(tx.ngrams_of(F.col("form"), dense)).alias("n_grams"), *[tx.countable_words(F.col("form")).alias("tokens")] * tokens)


def ngram_score(query: str) -> Column:
    """Jaccard similarity of the query's gram set with a chunk's, of the columns of ngram_features().

    Whether a gram is in a chunk's set shows in the chunk's forms, so sets are never built at query time.
    """
    grams = sorted(plain.ngram_set(query))
    if not grams:
        return F.lit(0.0)

    def has(g: str) -> Column:
        run = F.array_contains("runs", g)
        return (run | F.contains("dense", F.lit(g)) | F.contains("hangul", F.lit(g))) if len(g) in (2, 3) else run

    return tx.let(reduce(lambda a, c: a + c, [has(g).cast("int") for g in grams]), lambda both: both / (F.col("n_grams") + len(grams) - both))


def ngram_scores(features: DataFrame, query: str) -> DataFrame:
    """(chunk_id, score): ngram_score() of each chunk."""
    return features.select("chunk_id", ngram_score(query).alias("score"))


class OneQuery:
    """What one literal query finds in chunks, from one reading of their texts.

    words has (chunk_id, raw), the BM25 scores of the chunks that share a token with it; grams has (chunk_id,
    ngram) of all chunks; n_hits is the number of the former and most their highest score. Only lengths, the tokens
    that the query has and a similarity are kept of a text. A stored `index` and stored ngram_features() `features`
    stand in for the texts, and then only the postings of the query's tokens are read.
    """

    def __init__(self, chunks: DataFrame, query: str, k1: float = 1.5, b: float = 0.75, index: TermIndex | None = None, features: DataFrame | None = None) -> None:
        if index is not None:
            self.words = stage(index.scores_of(query, k1, b).select("chunk_id", F.col("score").alias("raw")), "words")
            self.grams = ngram_scores(ngram_features(chunks) if features is None else features, query).withColumnRenamed("score", "ngram")
        else:
            terms = {t: plain.bm25_tokens(query).count(t) for t in dict.fromkeys(plain.bm25_tokens(query))}
            read = stage(ngram_features(chunks, tokens=True).select("chunk_id", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(*terms or ("",))).alias("hits"), ngram_score(query).alias("ngram")), "read")
            n, mean, *frequencies = read.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0)), *[F.count_if(F.array_contains("hits", t)) for t in terms]).first()
            dl = F.col("dl") / F.lit(max(mean, 1e-9))

            def worth(term: str, times: int, df: int) -> Column:
                tf = F.size(F.filter("hits", lambda t: t == term))
                return F.lit(times * math.log((n - df + 0.5) / (df + 0.5) + 1.0)) * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl))

            raw = reduce(lambda x, y: x + y, [worth(t, times, df) for (t, times), df in zip(terms.items(), frequencies, strict=True)], F.lit(0.0))
            self.words = read.filter(F.size("hits") > 0).select("chunk_id", raw.alias("raw"))
            self.grams = read.select("chunk_id", "ngram")
        self.n_hits, most = self.words.agg(F.count("*"), F.max("raw")).first()
        self.most = most if most and most > 0 else 1.0


def ngram_scores_of(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score): ngram_scores() of many queries (query_id, query), by a join on their grams.

    Chunks that share no gram with a query, whose score is 0, are left out.
    """
    sets = lambda df, name, text, n: df.select(F.col(name), tx.ngram_set(text).alias("own")).select(name, F.size("own").alias(n), F.explode("own").alias("g"))
    asked = sets(queries, "query_id", F.col("query"), "m")
    body = searchable(*SEARCHED) if text is None else text
    own = sets(chunks.withColumn("chunk_id", F.col(key)), "chunk_id", body, "n")
    both = own.join(asked, "g").groupBy("query_id", "chunk_id").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    return both.select("query_id", "chunk_id", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("score"))


def _grams(batch: pa.RecordBatch, place: dict) -> scan.Found:
    """The gram sets (of tx.ngrams_of()) of search forms: those asked for, and how many there are."""
    terms, sizes, lengths = [], [], []
    for form in batch.column(1).to_pylist():
        dense = form.replace(" ", "")
        own = {run for run in _RUN.findall(form) if len(run) > 3}
        for text in dict.fromkeys((dense, _LATIN.sub("", dense))):
            pairs = list(map(add, text, text[1:]))
            own.update(pairs, map(add, pairs, text[2:]))
        hits = [place[g] for g in own & place.keys()]
        terms += hits
        sizes.append(len(hits))
        lengths.append(len(own))
    return scan.Found([batch.column(0)], np.array(sizes, np.int64), np.array(terms, np.int32), np.ones(len(terms), np.int8), np.array(lengths, np.float64))


def ngram_best_of(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: Column | None = None) -> DataFrame:
    """top_k() of ngram_scores_of() by scans: neither grams nor pairs of query and chunk are rows of a shuffle."""
    forms = chunks.select(F.col(key).alias("chunk_id"), tx.normalized(searchable(*SEARCHED) if text is None else text).alias("form"))
    asked = queries.select("query_id", F.explode(tx.ngram_set(F.col("query"))).alias("term")).distinct().withColumn("qtf", F.lit(1.0))
    share = lambda both, n, own: both / (n + len(own) - both)
    return scan.best_of_all(asked, ["chunk_id"], k, lambda part: scan.best(forms, ["chunk_id"], part, k, _grams, finish=share), "best")


def field_scores(chunks: DataFrame, terms: list[str], weights: dict[str, int] = FIELD_WEIGHTS) -> DataFrame:
    """`chunks` with match_score, of those with a term in any field: the sum of the weights of fields per term.

    chunks needs the weighted columns; normalized_body is made where it is missing.
    """
    if "normalized_body" not in chunks.columns:
        chunks = chunks.withColumn("normalized_body", tx.normalized(F.col("body")))
    if not terms:
        return chunks.withColumn("match_score", F.lit(0)).filter("false")
    lower = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in weights}
    total = reduce(lambda a, c: a + c, [F.when(F.contains(lower[f], F.lit(t)), w).otherwise(0) for t in terms for f, w in weights.items()])
    return chunks.withColumn("match_score", total).filter("match_score > 0")


def field_scores_of(chunks: DataFrame, queries: DataFrame, weights: dict[str, int] = FIELD_WEIGHTS) -> DataFrame:
    """(query_id, chunk_id, match_score): field_scores() of many queries (query_id, query).

    A term can only be where its first two characters are, so these are joined before fields are looked through.
    """
    if "normalized_body" not in chunks.columns:
        chunks = chunks.withColumn("normalized_body", tx.normalized(F.col("body")))
    asked = stage(queries.select("query_id", F.explode(tx.search_terms(F.col("query"))).alias("term")).distinct(), "terms")
    lower = stage(chunks.select("chunk_id", *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in weights]), "fields")
    begun = asked.select("term", F.substring("term", 1, 2).alias("begin")).distinct()
    near = lower.select("chunk_id", F.explode(tx.pieces(F.concat_ws("\n", *weights))).alias("begin")).join(begun, "begin").groupBy("chunk_id").agg(F.collect_list("term").alias("terms"))
    total = lambda t: reduce(lambda a, c: a + c, [F.when(F.contains(F.col(f), t), w).otherwise(0) for f, w in weights.items()])
    # Texts meet the terms of their chunk in one row, so that they are not shuffled once for each.
    worth = F.filter(F.transform("terms", lambda t: F.struct(t.alias("term"), total(t).alias("worth"))), lambda x: x["worth"] > 0)
    hits = near.join(lower, "chunk_id").select("chunk_id", F.inline(worth))
    return hits.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.sum("worth").alias("match_score"))


def _fields_found(weights: list[int]) -> Callable[[pa.RecordBatch, dict], scan.Found]:
    """The terms asked for that stand in fields, and what they are worth there; fields come after the key."""

    begins: dict[str, list[str]] = {}

    def found(batch: pa.RecordBatch, place: dict) -> scan.Found:
        if not begins:
            for t in place:
                begins.setdefault(t[:2], []).append(t)
        sizes, terms, worths = [], [], []
        for fields in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            whole = "\n".join(fields)
            size = 0
            for begin in ({*whole, *map(add, whole, whole[1:])}) & begins.keys():
                for t in begins[begin]:
                    # Of one or two characters, the term is its beginning.
                    if len(t) < 3 or t in whole:
                        worth = sum(w for f, w in zip(fields, weights, strict=True) if t in f)
                        if worth:
                            size += 1
                            terms.append(place[t])
                            worths.append(worth)
            sizes.append(size)
        return scan.Found([batch.column(0)], np.array(sizes, np.int64), np.array(terms, np.int32), np.array(worths, np.float64), np.zeros(len(sizes)))

    return found


def field_best_of(chunks: DataFrame, queries: DataFrame, limit: int, weights: dict[str, int] = FIELD_WEIGHTS) -> DataFrame:
    """(query_id, chunk_id, match_score, rank): best_fields_of() of field_scores_of() by scans, each text read once where it lies.

    A term can only be where its first two characters are, so texts are looked through for those alone.
    """
    if "normalized_body" not in chunks.columns:
        chunks = chunks.withColumn("normalized_body", tx.normalized(F.col("body")))
    asked = queries.select("query_id", F.explode(tx.search_terms(F.col("query"))).alias("term")).distinct().withColumn("qtf", F.lit(1.0))
    # Latest first, without a time last; then by source, null first.
    late = F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("late")
    origin = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("")).alias("origin")
    # Of each chunk only its place in that order is sent on, not the texts that make it.
    places = numbered(chunks.select("chunk_id", late, origin), ["late", "origin", "chunk_id"], "place").select("chunk_id", "place")
    lower = chunks.join(places, "chunk_id").select("place", *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"_{f}") for f in weights])
    most = max(1, min(limit, 200))
    best = scan.best_of_all(asked, ["place"], most, lambda part: scan.best(lower, ["place"], part, most, _fields_found(list(weights.values()))), "best")
    return best.join(places, "place").select("query_id", "chunk_id", F.col("score").cast("bigint").alias("match_score"), "rank")


def best_fields_of(scored: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """best_fields() of each query of field_scores_of(), with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), F.desc_nulls_last("updated_at"), "source", "chunk_id")
    rows = scored.join(chunks.select("chunk_id", "updated_at", "source"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, min(limit, 200)))


def best_fields(scored: DataFrame, limit: int) -> DataFrame:
    """The first `limit` (1 to 200) rows by match_score, then latest, source and chunk."""
    return scored.orderBy(F.desc("match_score"), F.desc_nulls_last("updated_at"), "source", "chunk_id").limit(max(1, min(limit, 200)))


def document_scores(docs: DataFrame, query: str) -> DataFrame:
    """`docs` with score: the whole query in the title 20, each word in title 6, source 3, customer 3, body 1.

    The body is the part of the content around the query's first word.
    """
    terms, whole = plain.words(query), plain.normalize(query)
    body = tx.focused(F.lit(query), F.col("content"))
    forms = docs.filter("content is not null").select("*", tx.normalized(F.col("title")).alias("_t"), tx.normalized(F.col("source")).alias("_s"), tx.normalized(F.col("customer")).alias("_c"), body.alias("_focus")).withColumn("_b", tx.normalized(F.col("_focus"))).filter("_focus != ''")
    score = F.when(F.contains("_t", F.lit(whole)), 20.0).otherwise(0.0) if whole else F.lit(0.0)
    for t in terms:
        for column, weight in (("_t", 6.0), ("_s", 3.0), ("_c", 3.0), ("_b", 1.0)):
            score = score + F.when(F.contains(column, F.lit(t)), weight).otherwise(0.0)
    return forms.withColumn("score", score).drop("_t", "_s", "_c", "_b", "_focus")


def any_term(docs: DataFrame, terms: list[str], fields: tuple[str, ...] = ("title", "customer", "source", "content")) -> DataFrame:
    """Documents with one of `terms` in one of `fields`, without regard to case."""
    return docs.filter(reduce(lambda a, c: a | c, [tx.any_of(F.lower(F.coalesce(F.col(f), F.lit(""))), tuple(terms)) for f in fields]) if terms else F.lit(False))


def cosine_scores(chunks: DataFrame, query: str, text: Column) -> DataFrame:
    """(chunk_id, score): cosine of the counts of legacy grams, by a join on the query's grams."""
    spark = chunks.sparkSession
    asked = query_frame(spark, query).select(F.explode(tx.legacy_grams(F.col("query"))).alias("g")).groupBy("g").agg(F.count("*").alias("q"))
    grams = chunks.select("chunk_id", F.explode(tx.legacy_grams(text)).alias("g")).groupBy("chunk_id", "g").agg(F.count("*").alias("c"))
    norms = grams.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    dots = grams.join(asked, "g").groupBy("chunk_id").agg(F.sum(F.col("c") * F.col("q")).alias("dot"))
    own = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("own"))
    return dots.join(norms, "chunk_id").join(F.broadcast(own)).select("chunk_id", (F.col("dot") / (F.col("norm") * F.col("own"))).alias("score"))


def cosine_search(chunks: DataFrame, query: str, k: int, shared_folder: str = "공통자료") -> DataFrame:
    """The best `k` chunks by cosine_scores() with boosts, of those with a score over 0.

    A query that names the chunk's top folder adds 0.55, and each of its terms in source or title 0.04; chunks of
    `shared_folder` lose 0.35 unless reports are asked for; where access is asked for, each access word in title and
    body adds 0.035, up to 0.28. chunks have chunk_id, source, title and body; equal scores go by chunk_id.
    """
    dense = query.lower().replace(" ", "")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    own = cosine_scores(chunks, query, F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    rows = chunks.select("chunk_id", "source", "title", "body").join(own, "chunk_id", "left")
    name, folder = F.concat(low("source"), F.lit(" "), low("title")), F.lower(F.substring_index(F.coalesce("source", F.lit("")), "/", 1))
    terms = sorted(set(re.findall("[가-힣A-Za-z0-9_]{2,}", query.lower())))
    boost = F.when((folder != "") & F.contains(F.lit(dense), folder), 0.55).otherwise(0.0)
    boost = reduce(lambda a, t: a + F.when(F.contains(name, F.lit(t)), 0.04).otherwise(0.0), terms, boost)
    if not any(w in dense for w in REPORT_WORDS):
        boost = boost - F.when(folder == shared_folder, 0.35).otherwise(0.0)
    if any(w in dense for w in ACCESS_ASKED):
        text = F.concat_ws("\n", low("title"), low("body"))
        boost = boost + F.least(reduce(lambda a, w: a + F.when(F.contains(text, F.lit(w)), 0.035).otherwise(0.0), ACCESS_WORDS, F.lit(0.0)), F.lit(0.28))
    scored = rows.select("chunk_id", (F.coalesce("score", F.lit(0.0)) + boost).alias("score"))
    return scored.orderBy(F.round("score", 9).desc(), "chunk_id").limit(k).filter("score > 0")
