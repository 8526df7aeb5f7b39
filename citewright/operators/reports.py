"""Tables about a corpus, its questions, labels and log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.operators import evaluation as E
from citewright.operators.chunking import n_tokens


def article_table(units: DataFrame) -> DataFrame:
    """One row for each article: clauses, words of its texts in order, units amended and units repealed."""
    rows = units.filter("article is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("pos", "text")))), lambda x: x["text"])
    counted = rows.groupBy("doc_id", "article").agg(
        F.first("article_title", ignorenulls=True).alias("article_title"), F.sum((F.col("clause").isNotNull() & F.col("point").isNull()).cast("bigint")).alias("n_clauses"), F.array_join(texts, "\n").alias("text"),
        F.sum((F.size(F.coalesce("amended_by", F.array().cast("array<string>"))) > 0).cast("bigint")).alias("n_amended"), F.sum((F.coalesce("status", F.lit("active")) == "repealed").cast("bigint")).alias("n_repealed"),
    )
    return counted.withColumn("n_words", n_tokens(F.col("text")).cast("bigint"))


def chunk_kinds(chunks: DataFrame) -> DataFrame:
    """(doc_id, kind, count): whole articles, clauses, parts of a clause and parts of an article, by the form of their id."""
    kind = F.when(F.col("chunk_id").rlike("__K.*__P"), "part of a clause").when(F.col("chunk_id").rlike("__P"), "part of an article").when(F.col("chunk_id").rlike("__K"), "clause").otherwise("article")
    return chunks.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("count"))


def group_headers(questions: DataFrame) -> DataFrame:
    """(group_id, kind, n_questions): a group is of its first question's type."""
    return questions.groupBy("group_id").agg(F.min_by("type", "query_id").alias("kind"), F.count("*").alias("n_questions"))


def split_sizing(groups: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """groups (kind, split, n_questions): groups and questions of each kind in each split, and of all kinds ('all')."""
    sums = [x for s in splits for x in (F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_groups"), F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_questions"))), F.lit(0)).alias(f"{s}_questions"))]
    return groups.rollup("kind").agg(*sums, F.grouping("kind").alias("g")).withColumn("kind", F.when(F.col("g") == 1, "all").otherwise(F.col("kind"))).drop("g")


def manifest_counts(questions: DataFrame, splits: DataFrame) -> DataFrame:
    """(what, name, count): questions, groups, questions of each type, groups and questions of each split."""
    rows = questions.join(splits.select("group_id", "split"), "group_id", "left")
    part = lambda what, name, count, by=None: (rows.groupBy(by) if by else rows.groupBy()).agg(count.alias("count")).select(F.lit(what).alias("what"), (F.col(by) if by else F.lit(name)).alias("name"), "count")
    parts = [
        part("total", "questions", F.count("*")), part("total", "groups", F.countDistinct("group_id")), part("questions by type", "", F.count("*"), "type"),
        part("groups by split", "", F.countDistinct("group_id"), "split"), part("questions by split", "", F.count("*"), "split"),
    ]
    return reduce(DataFrame.unionByName, parts)


def agreement(first: DataFrame, second: DataFrame, questions: DataFrame) -> DataFrame:
    """One row on two raters' verdicts: questions, kappa of the verdicts, and how often each agrees with the type.

    Each rater: (query_id, verdict?, type_agree?, n_labels). A verdict not given follows from the
    labels: answerable with any, no_answer without. Rates are null where a rater said nothing.
    """
    given = lambda rows, name: rows.select("query_id", F.coalesce("verdict", F.when(F.coalesce("n_labels", F.lit(0)) > 0, "answerable").otherwise("no_answer")).alias(name), F.when(F.col("type_agree").isNotNull(), (F.col("type_agree") == "yes").cast("double")).alias(f"{name}_agree"))
    rows = questions.select("query_id").join(given(first, "x"), "query_id", "left").join(given(second, "y"), "query_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("no_answer")) for c in ("x", "y")})
    rates = rows.agg(F.avg("x_agree").alias("agree_first"), F.avg("y_agree").alias("agree_second"), F.coalesce(F.sum((F.col("x") != F.col("y")).cast("bigint")), F.lit(0)).alias("n_differ"))
    return E.kappa(rows.select("x", "y")).crossJoin(F.broadcast(rates))  # a row each


def kappa_report(pool: DataFrame, least: float = 0.6) -> DataFrame:
    """pool (query_id, doc_id, x, y) of graded labels: pairs, pairs that differ, kappa of relevance, weighted kappa, and whether the first is below ``least``."""
    binary = E.kappa(pool.select((F.col("x") > 0).cast("int").alias("x"), (F.col("y") > 0).cast("int").alias("y"))).select("n", F.col("kappa").alias("kappa"))
    graded = E.kappa(pool.select("x", "y"), weighted=True).select(F.col("kappa").alias("kappa_weighted"))
    differ = pool.agg(F.coalesce(F.sum((F.col("x") != F.col("y")).cast("bigint")), F.lit(0)).alias("n_differ"))
    return binary.crossJoin(F.broadcast(graded)).crossJoin(F.broadcast(differ)).withColumn("review", F.coalesce(F.col("kappa") < least, F.lit(False)))  # a row each


def label_differences(pool: DataFrame) -> DataFrame:
    return pool.filter("x != y").select("query_id", "doc_id", "x", "y")


def multi_intent_table(runs: DataFrame, quoted: DataFrame, qrels: DataFrame) -> DataFrame:
    """For each mode: questions, mean recall at 5 and 10 and NDCG at 5 of the sources, share of the best documents quoted, and right quotations.

    runs: (mode, query_id, doc_id, rank); quoted: (mode, query_id, doc_id). The best documents are
    those of relevance 2 or, for a question without any, all relevant ones.
    """
    modes = [r[0] for r in runs.select("mode").distinct().orderBy("mode").collect()]  # a handful
    gold = qrels.filter("relevance > 0").withColumn("top", F.max("relevance").over(Window.partitionBy("query_id"))).withColumn("best", (F.col("relevance") == 2) | (F.col("top") < 2))
    out = []
    for mode in modes:
        run = runs.filter(F.col("mode") == mode)
        per_query = E.ranking_metrics(run, qrels, (5, 10))
        hit = quoted.filter(F.col("mode") == mode).select("query_id", "doc_id").distinct().join(gold, ["query_id", "doc_id"])
        cover = hit.groupBy("query_id").agg(F.sum(F.col("best").cast("int")).alias("covered"), F.count("*").alias("right"))
        n_best = gold.groupBy("query_id").agg(F.sum(F.col("best").cast("int")).alias("n_best"))
        rows = per_query.join(n_best, "query_id").join(cover, "query_id", "left")
        out.append(
            rows.agg(
                F.count("*").alias("n"), F.avg("recall_5").alias("recall_5"), F.avg("recall_10").alias("recall_10"), F.avg("ndcg_5").alias("ndcg_5"),
                F.avg(F.coalesce("covered", F.lit(0)) / F.col("n_best")).alias("coverage"), F.avg(F.coalesce("right", F.lit(0)).cast("double")).alias("right_quotes"),
            ).withColumn("mode", F.lit(mode))
        )
    return reduce(DataFrame.unionByName, out)


def compare_stages(per_query: DataFrame, pairs: list[tuple[str, str]], metric: str, n_boot: int = 10_000) -> DataFrame:
    """For each pair (new, old) of stages: questions, both means, their difference with its bootstrap interval, better, worse, p and p after Holm.

    per_query: (stage, query_id, <metric>); a pair is compared on the questions that both have.
    """
    rows = []
    for new, old in pairs:
        a = per_query.filter(F.col("stage") == new).select("query_id", F.col(metric).alias("new_value"))
        both = a.join(per_query.filter(F.col("stage") == old).select("query_id", F.col(metric).alias("old_value")), "query_id")
        diffs = E.numbered(both.withColumn("diff", F.col("new_value") - F.col("old_value")), "query_id").select("i", "diff", "new_value", "old_value")
        count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
        means = diffs.agg(F.count("*").alias("n"), F.avg("old_value").alias("old_mean"), F.avg("new_value").alias("new_mean"), F.avg("diff").alias("diff"), count(F.col("diff") > 0).alias("better"), count(F.col("diff") < 0).alias("worse"))
        tested = E.bootstrap_interval(diffs.select("i", "diff"), n_boot).crossJoin(F.broadcast(E.sign_flip(diffs.select("i", "diff"), n_boot)))
        rows.append(means.crossJoin(F.broadcast(tested)).withColumns({"metric": F.lit(metric), "new": F.lit(new), "old": F.lit(old)}))
    return E.holm(reduce(DataFrame.unionByName, rows), "p", "new", ["metric"])


def compare_quotes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two scorers' quotations (query_id, quote, f1): questions, changed ones, mean F1 of both and, of the changed, better, worse and equal with the second."""
    rows = first.select("query_id", F.col("quote").alias("qa"), F.col("f1").alias("fa")).join(second.select("query_id", F.col("quote").alias("qb"), F.col("f1").alias("fb")), "query_id")
    changed = F.col("qa") != F.col("qb")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return rows.agg(
        F.count("*").alias("n"), count(changed).alias("changed"), F.avg("fa").alias("f1_first"), F.avg("fb").alias("f1_second"),
        count(changed & (F.col("fb") > F.col("fa"))).alias("better"), count(changed & (F.col("fb") < F.col("fa"))).alias("worse"), count(changed & (F.col("fb") == F.col("fa"))).alias("equal"),
    )


def freeze_checks(chunks: DataFrame, questions: DataFrame, qrels: DataFrame, sources: DataFrame, splits: DataFrame, types: tuple[str, ...], unanswerable: tuple[str, ...] = ("out_of_scope", "unsupported"), split_names: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """(severity, rule, key): what keeps the data from being frozen, and what should be looked at.

    chunks: (chunk_id, chunk_text); questions: (query_id, group_id, type, question, source); qrels:
    (query_id, chunk_id, relevance); sources: (doc_id, url, accessed_at, status); splits: (group_id, split).
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    show = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    rule = lambda name, rows, key, severity="error": rows.select(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), key.cast("string").alias("key")).distinct()
    repeated = lambda rows, *c: rows.groupBy(*c).count().filter("count > 1")
    labelled, free = qrels.select("query_id").distinct(), F.coalesce(F.col("type").isin(*unanswerable), F.lit(False))
    of_split = questions.join(splits.select("group_id", "split"), "group_id", "left")
    spark = questions.sparkSession
    kinds = spark.createDataFrame([(t,) for t in types], "type string")
    wanted = kinds.crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in split_names], "split string")))  # both lists are short
    spelt = questions.withColumn("t", F.lower(F.trim("question")))
    parts = [
        rule("source without url, date or status", sources.filter(blank("url") | blank("accessed_at") | blank("status")), F.col("doc_id")),
        rule("repeated chunk", repeated(chunks, "chunk_id"), F.col("chunk_id")),
        rule("empty chunk", chunks.filter(blank("chunk_text")), F.col("chunk_id")),
        rule("repeated question", repeated(questions, "query_id"), F.col("query_id")),
        rule("unknown type", questions.filter(~F.coalesce(F.col("type").isin(*types), F.lit(False))), F.col("query_id")),
        rule("type without question", kinds.join(questions.select("type").distinct(), "type", "left_anti"), F.col("type")),
        rule("repeated text", repeated(spelt, "t"), F.col("t"), "warning"),
        rule("label of no question", qrels.join(questions.select("query_id"), "query_id", "left_anti"), F.col("query_id")),
        rule("label of no chunk", qrels.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), show("query_id", "chunk_id")),
        rule("relevance other than 1 or 2", qrels.filter(~F.coalesce(F.col("relevance").cast("string").isin("1", "2"), F.lit(False))), show("query_id", "chunk_id")),
        rule("label of an unanswerable question", questions.filter(free).join(labelled, "query_id", "left_semi"), F.col("query_id")),
        rule("question without label", questions.filter(~free).join(labelled, "query_id", "left_anti"), F.col("query_id")),
        rule("repeated label", repeated(qrels, "query_id", "chunk_id"), show("query_id", "chunk_id")),
        rule("group in several splits", repeated(splits.select("group_id", "split").distinct(), "group_id"), F.col("group_id")),
        rule("group in no split", questions.select("group_id").distinct().join(splits.select("group_id"), "group_id", "left_anti"), F.col("group_id")),
        rule("type missing from a split", wanted.join(of_split.select("type", "split").distinct(), ["type", "split"], "left_anti"), show("split", "type"), "warning"),
        rule("generated question", questions.filter("source = 'generated'"), F.col("query_id"), "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


def log_with_sources(queries: DataFrame, chunks: DataFrame, topic: Column, cite: Column, no_topic: str = "–") -> DataFrame:
    """queries (..., top_chunk_id) with topic and citation of the chunk that answered; a placeholder and an empty text where there is none."""
    known = chunks.select(F.col("doc_id").alias("__c"), topic.alias("topic"), cite.alias("citation"))
    rows = queries.join(known, F.col("top_chunk_id") == F.col("__c"), "left").drop("__c")
    return rows.withColumns({"topic": F.coalesce("topic", F.lit(no_topic)), "citation": F.coalesce("citation", F.lit(""))})


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, order): each value once, where it first occurs."""
    return rows.groupBy(value).agg(F.min(order).alias(order))


def public_parts(parts: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """parts (query_id, part, ...) with top_chunks, the first ids of their hits (query_id, part, doc_id, rank), and nothing else of these."""
    top = hits.filter(F.col("rank") <= most).groupBy("query_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("top_chunks"))
    return parts.join(top, ["query_id", "part"], "left")


def choose_thresholds(tops: DataFrame, most_wrong: float = 0.1) -> DataFrame:
    """For each pipeline: its best threshold with and without the evidence check, whether the check stays, and the threshold that goes with that.

    tops: (pipeline, query_id, score, lacking, answerable), a row for each question; lacking:
    whether the evidence check would refuse it.
    """
    score = F.round(F.coalesce("score", F.lit(0.0)), 6)
    rows = tops.withColumn("s", score)
    middle = rows.select("pipeline", "s").distinct().withColumn("t", (F.col("s") + F.lead("s").over(Window.partitionBy("pipeline").orderBy("s"))) / 2)
    tried = middle.select("pipeline", F.col("t").alias("threshold")).filter("threshold is not null").unionByName(rows.select("pipeline", F.lit(0.0).alias("threshold"))).distinct()
    modes = F.explode(F.array(F.lit(False), F.lit(True))).alias("check")
    refused = ((F.col("s") < F.col("threshold")) | (F.col("check") & F.col("lacking"))).cast("double")
    rates = rows.join(tried, "pipeline").select("*", modes).groupBy("pipeline", "check", "threshold").agg(F.avg(F.when(~F.col("answerable"), refused)).alias("correct"), F.avg(F.when(F.col("answerable"), refused)).alias("wrong"))
    ok = (F.coalesce("wrong", F.lit(0.0)) <= most_wrong) & F.col("correct").isNotNull()
    best = rates.groupBy("pipeline", "check").agg(F.max_by(F.struct("threshold", "correct", "wrong"), F.when(ok, F.struct(F.round("correct", 9), -F.col("threshold")))).alias("b"), F.min_by(F.struct("threshold", "correct", "wrong"), "threshold").alias("none"))
    best = best.withColumn("b", F.coalesce("b", "none")).groupBy("pipeline").agg(F.max(F.when(~F.col("check"), F.col("b"))).alias("off"), F.max(F.when(F.col("check"), F.col("b"))).alias("on"))
    keep = F.coalesce((F.col("on.correct") >= F.col("off.correct")) & (F.coalesce("on.wrong", F.lit(0.0)) <= most_wrong), F.lit(False))
    return best.select("pipeline", F.col("off.threshold").alias("threshold_without"), F.col("on.threshold").alias("threshold_with"), keep.alias("check"), F.round(F.when(keep, F.col("on.threshold")).otherwise(F.col("off.threshold")), 6).alias("threshold"))
