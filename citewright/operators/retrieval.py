"""Sparse and dense ranking, fusion and reranking of sets of queries.

Queries are DataFrames (query_id, ...), documents (doc_id, ...); the order of doc_id
breaks ties. Scores come as rows (query_id, doc_id, score) of documents with a positive
score; ``with_zeros`` gives what a full score vector would.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions import text as T
from citewright.operators.sparse import Bm25, Common, Field, Index, Tfidf, alike, settled  # noqa: F401  (settled for the other operators)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.9, words: Column | None = None) -> DataFrame:
    """idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), idf = ln(1 + (N - df + .5) / (df + .5)); a word repeated in a query counts as often."""
    words = T.tokens(F.col("text")) if words is None else words
    return Index(docs, [Field(words, queries)]).scores(score=Bm25(0, k1, b))


def tfidf(docs: DataFrame, queries: DataFrame, least: int = 1, most: int = 2, sublinear: bool = True) -> DataFrame:
    """Cosine of (1 + ln tf) (ln((1 + N) / (1 + df)) + 1) over n-grams; terms unknown to the documents are ignored."""
    return Index(docs, [Field(T.tokens(F.col("text")), queries, least, most, True, sublinear)]).scores(score=Tfidf(0, sublinear))


def bm25_and_tfidf(docs: DataFrame, queries: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, bm25, tfidf) by both with their usual settings in one pass, null where a list lacks the document, and the columns of ``also`` (doc_id, ...)."""
    return Index(docs, [Field(T.tokens(F.col("text")), queries, 1, 2, True)], also).scores(bm25=Bm25(), tfidf=Tfidf())


def sparse_index(docs: DataFrame, queries: DataFrame) -> Index:
    """What BM25 and TF-IDF with their usual settings are scored from."""
    return Index(docs, [Field(T.tokens(F.col("text")), queries, 1, 2, True)])


def minmax_top_k(index: Index, first: Bm25 | Tfidf, second: Bm25 | Tfidf, weight: float, k: int, digits: int = 6) -> DataFrame:
    """top_k of weight * scaled first + (1 - weight) * scaled second over all documents, as ``fuse_minmax`` scales them; pairs are scored, scaled and ranked in their task."""
    bounds = index.bounds(a=first, b=second)

    def mixed(sums):
        parts = [np.where(high - low < 1e-12, 0.0, (s - low) / np.where(high - low < 1e-12, 1.0, high - low)) for s, (low, high) in zip(sums, bounds, strict=True)]
        return weight * parts[0] + (1 - weight) * parts[1]

    best = index.best({"mixed": k}, digits, "all", mixed, a=first, b=second)
    return top_k(best.select("query_id", "doc_id", F.col("mixed").alias("score")), k, digits)


def rrf_top_k(index: Index, first: Bm25 | Tfidf, second: Bm25 | Tfidf, weights: tuple[float, float], k: int, rrf_k: int = 60, digits: int = 9) -> DataFrame:
    """top_k of ``fuse_rrf``. What is not among the ``depth`` best of either list is below the k best of one list, so only these are ranked, among all documents."""
    if min(weights) <= 0:
        raise ValueError("weights are above 0")
    depth = math.ceil(sum(weights) / min(weights) * (rrf_k + k)) - rrf_k
    pool = index.best({"a": depth, "b": depth}, of="any", a=first, b=second)
    pool = top_k(pool.withColumn("score", F.coalesce("a", F.lit(0.0))), depth).drop("score", "rank").union(top_k(pool.withColumn("score", F.coalesce("b", F.lit(0.0))), depth).drop("score", "rank")).distinct()
    places = index.places(pool, a=first, b=second)
    return top_k(places.select("query_id", "doc_id", sum(w / (rrf_k + F.col(c)) for c, w in zip("ab", weights, strict=True)).alias("score")), k, digits)


def best_candidates(index: Index, first: Bm25 | Tfidf, extra: Bm25 | Tfidf, n: int, extras: int) -> DataFrame:
    """``candidates``; only what may be among a list's best leaves its task."""
    return candidates_of(settled(index.best({"first": n, "extra": extras}, first=first, extra=extra)), "first", "extra", n, extras)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, digits: int = 6, itself: bool = True) -> DataFrame:
    """The k nearest by cosine of unit vectors: (query_id, vector) against (doc_id, vector), integer ids; without ``itself`` equal ids do not meet.

    Queries go out in blocks of at most ``block``; each batch of vectors is multiplied by a block
    at once and sends only its own k best of each query on.
    """
    ids = [r[0] for r in queries.select("query_id").orderBy("query_id").collect()]  # ids only
    out = None
    for a in range(0, max(1, len(ids)), block):
        here = ids[a : a + block]
        rows = queries.filter(F.col("query_id").between(here[0], here[-1])).select("query_id", "vector").toArrow() if here else None
        part = _nearest(vectors, rows, k, digits, itself)
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, digits)


def _nearest(vectors: DataFrame, queries: pa.Table | None, k: int, digits: int, itself: bool) -> DataFrame:
    matrix = lambda c, n: np.asarray(c.combine_chunks().flatten() if isinstance(c, pa.ChunkedArray) else c.flatten(), np.float64).reshape(n, -1)
    n = 0 if queries is None else queries.num_rows
    shared = vectors.sparkSession.sparkContext.broadcast((queries["query_id"].to_numpy(), matrix(queries["vector"], n)) if n else None)

    def run(batches):
        if shared.value is None:
            return
        q, m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(0).to_numpy()
            scores = m @ matrix(b.column(1), len(d)).T
            if not itself:
                scores[q[:, None] == d[None, :]] = -np.inf
            order = np.lexsort([np.broadcast_to(d, scores.shape), -np.round(scores, digits)], axis=1)[:, :k]
            best = np.take_along_axis(scores, order, 1).ravel()
            keep = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, order.shape[1])[keep]), pa.array(d[order.ravel()][keep]), pa.array(best[keep])], ["query_id", "doc_id", "score"])

    return vectors.select(F.col("doc_id").cast("bigint"), "vector").mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos): places from 1 in the order of the ids; ranges are counted, so no task numbers them all."""
    rows = docs.select("doc_id").repartitionByRange("doc_id").withColumn("p", F.spark_partition_id())
    counts = rows.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.select(F.col("p"), (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("p").orderBy("doc_id"))
    return rows.withColumn("nth", place).join(F.broadcast(before), "p").select("doc_id", (F.col("before") + F.col("nth")).cast("bigint").alias("pos"))


def with_zeros(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """scores and, with 0, the first k documents in order: enough for any top k of the full vector."""
    first = docs.select("doc_id").orderBy("doc_id").limit(k)  # k rows
    zeros = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    return scores.unionByName(zeros).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def top_k_of_all(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """top_k of the full score vectors; only the k best of those with a row meet the zeros."""
    return top_k(with_zeros(top_k(scores, k).select("query_id", "doc_id", "score"), docs, queries, k), k)


def top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query with their rank; equal scores (to ``digits``) keep document order."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def minmax(scores: DataFrame, n_docs: int, by: str = "query_id") -> DataFrame:
    """score scaled to 0..1 over the whole corpus: where a document has no row its score of 0 counts."""
    w = Window.partitionBy(by)
    low = F.when(F.count("*").over(w) < n_docs, F.least(F.min("score").over(w), F.lit(0.0))).otherwise(F.min("score").over(w))
    high = F.when(F.count("*").over(w) < n_docs, F.greatest(F.max("score").over(w), F.lit(0.0))).otherwise(F.max("score").over(w))
    return scores.select(by, "doc_id", "score", low.alias("low"), high.alias("high")).select(
        by, "doc_id", F.when(F.col("high") - F.col("low") < 1e-12, F.lit(0.0)).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).alias("score")
    )


def fuse_minmax(first: DataFrame, second: DataFrame, weight: float, n_docs: int) -> DataFrame:
    """weight * scaled first + (1 - weight) * scaled second."""
    a = minmax(first, n_docs).withColumnRenamed("score", "a")
    b = minmax(second, n_docs).withColumnRenamed("score", "b")
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", (weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0))).alias("score"))


def fused_minmax(both: DataFrame, first: str, second: str, weight: float, n_docs: int) -> DataFrame:
    """The same for lists that are columns of one table, as ``score``: their bounds are a row for each query."""
    bounds = both.groupBy("query_id").agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate((first, second)) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))])
    rows, scaled = both.join(F.broadcast(bounds), "query_id"), []
    for i, c in enumerate((first, second)):
        lacks = F.col(f"__n{i}") < n_docs
        low, high = (F.when(lacks, f(F.col(f"__{n}{i}"), F.lit(0.0))).otherwise(F.col(f"__{n}{i}")) for n, f in (("low", F.least), ("high", F.greatest)))
        scaled.append(F.coalesce(F.when(F.col(c).isNull() | (high - low < 1e-12), F.lit(0.0)).otherwise((F.col(c) - low) / (high - low)), F.lit(0.0)))
    return rows.select(*both.columns, (weight * scaled[0] + (1 - weight) * scaled[1]).alias("score"))


def fuse_rrf(first: DataFrame, second: DataFrame, weights: tuple[float, float], positions: DataFrame, rrf_k: int = 60, digits: int = 6) -> DataFrame:
    """Sum of weight / (rrf_k + rank) over both lists, for documents with a positive score in either.

    A document that a list lacks has the rank it would get there with score 0: after
    all positive ones, in document order. positions: (doc_id, pos), pos from 1 in document order.
    """
    both = first.withColumnRenamed("score", "a").join(second.withColumnRenamed("score", "b"), ["query_id", "doc_id"], "full_outer").join(positions, "doc_id")
    return fused_rrf(both, "a", "b", weights, rrf_k, digits)


def fused_rrf(both: DataFrame, first: str, second: str, weights: tuple[float, float], rrf_k: int = 60, digits: int = 6) -> DataFrame:
    """The same for lists that are columns of one table with pos."""
    total = None
    for column, weight in zip((first, second), weights, strict=True):
        has = F.when(F.col(column) > 0, 1).otherwise(0)
        of_query = Window.partitionBy("query_id")
        ranked = F.row_number().over(of_query.orderBy(F.desc(F.round(F.coalesce(column, F.lit(0.0)), digits)), "doc_id"))
        before = F.sum(has).over(of_query.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
        rank = F.when(has == 1, ranked).otherwise(F.sum(has).over(of_query) + F.col("pos") - before)
        part = weight / (rrf_k + rank)
        total = part if total is None else total + part
    return both.select("query_id", "doc_id", total.alias("score"))


def candidates(first: DataFrame, extra: DataFrame, n: int, extras: int) -> DataFrame:
    """The n best of the first stage, and of the second's ``extras`` best those not among them, with their first-stage score."""
    top = top_k(first, n).select("query_id", "doc_id", "score", F.col("rank").alias("place"))
    more = top_k(extra.filter("score > 0"), extras).select("query_id", "doc_id", F.col("rank").alias("r"))
    more = more.join(top, ["query_id", "doc_id"], "left_anti").join(first, ["query_id", "doc_id"], "left")
    return top.unionByName(more.select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), (n + F.col("r")).alias("place")))


def candidates_of(both: DataFrame, first: str, extra: str, n: int, extras: int) -> DataFrame:
    """The same for lists that are columns of one table: no join to all of the first stage's scores."""
    list_of = lambda c: both.filter(F.col(c).isNotNull()).select("query_id", "doc_id", F.col(c).alias("score"), F.coalesce(first, F.lit(0.0)).alias("of_first"))
    top = top_k(list_of(first), n).select("query_id", "doc_id", "score", F.col("rank").alias("place"))
    more = top_k(list_of(extra).filter("score > 0"), extras).join(top, ["query_id", "doc_id"], "left_anti")
    return top.unionByName(more.select("query_id", "doc_id", F.col("of_first").alias("score"), (n + F.col("rank")).alias("place")))


def rerank(scored: DataFrame, blend: float = 0.0, norm: str = "raw", probability: bool = True) -> DataFrame:
    """scored: (query_id, doc_id, score, place, ce). blend * scaled score + (1 - blend) * ce, best first, ties by place.

    ``raw`` takes the pair score as it is (or its sigmoid, if it is no probability);
    ``minmax`` scales it over the query's candidates, unless blend is 0.
    """
    if norm not in ("raw", "minmax"):
        raise ValueError(f"unknown norm {norm!r}")
    w = Window.partitionBy("query_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))

    rows = scored if probability or norm == "minmax" else scored.withColumn("ce", T.sigmoid(F.col("ce")))
    ce = scaled("ce") if norm == "minmax" and blend else F.col("ce")
    rows = rows.withColumn("final", blend * scaled("score") + (1 - blend) * ce)
    order = w.orderBy(F.desc(F.round("final", 6)), "place")
    return rows.select("query_id", "doc_id", F.col("final").alias("score"), F.row_number().over(order).alias("rank"))


def hard_negatives(run: DataFrame, qrels: DataFrame, articles: DataFrame, per_positive: int = 4) -> DataFrame:
    """Of a run (query_id, doc_id, rank), what is neither labelled nor of a labelled document's article; per_positive for each positive.

    articles: (doc_id, article). Ranks are those before anything was left out.
    """
    gold = qrels.join(articles, "doc_id").select("query_id", "article").distinct()
    left = run.join(qrels, ["query_id", "doc_id"], "left_anti").join(articles, "doc_id").join(gold, ["query_id", "article"], "left_anti")
    most = qrels.groupBy("query_id").agg((per_positive * F.count("*")).alias("most"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return left.join(most, "query_id").withColumn("nth", order).filter("nth <= most").select("query_id", "doc_id", "rank", "nth")


def _best_of_task(pairs: DataFrame, k: int, at_once: int = 500_000) -> DataFrame:
    """Of each task's rows, the best of each group that is among the query's k best: no other can be in the end."""
    columns = ["query_id", "doc_id", "group", "score"]

    def run(batches):
        def best(rows):
            df = pa.Table.from_batches(rows).to_pandas().sort_values(["query_id", "__r", "doc_id"], ascending=[True, False, True])
            df = df.drop_duplicates(["query_id", "group"]).groupby("query_id").head(k)
            return [pa.RecordBatch.from_pandas(df, schema=rows[0].schema, preserve_index=False)]

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= at_once:
                held = best(held)
                n = 0
        if held:
            yield from (b.select(columns) for b in best(held))

    rows = pairs.select(*columns, F.round("score", 6).alias("__r"))
    return rows.mapInArrow(run, rows.select(*columns).schema)


def similar(pairs: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """pairs: (query_id, doc_id, group, score), rows of equal text left out. The best of each group, at least ``least``, k in all."""
    return _best_groups(_best_of_task(pairs.filter(F.round("score", 6) >= least), k), k)


def similar_sets(docs: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.3) -> DataFrame:
    """``similar`` by Dice of sets of words, as ``alike`` takes them: (query_id, doc_id, group, score, rank); pairs never leave their task, only its best."""
    return _best_groups(alike(docs, queries, k, least).repartition("query_id"), k)


def _best_groups(pairs: DataFrame, k: int) -> DataFrame:
    in_group = Window.partitionBy("query_id", "group").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return top_k(pairs.withColumn("g", F.row_number().over(in_group)).filter("g = 1").drop("g"), k)


def interleave(lists: DataFrame, k: int) -> DataFrame:
    """lists: (query_id, part, rank, doc_id). By rank, then part; a document counts at its first place."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("rank", "part")
    rows = lists.withColumn("n", F.row_number().over(first)).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "part"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "place", "doc_id", "part", "rank")
