"""Ranking metrics, refusal thresholds, grids, significance and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), depth: int = 10) -> DataFrame:
    """(query_id, recall_k..., rr, ndcg_k...) of the labelled queries in a run (query_id, doc_id, rank), to ``depth``.

    Recall and NDCG are 0 for a query without positives; a document without a label has relevance 0.
    """
    labelled = qrels.filter("relevance > 0")
    ideal = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    best = labelled.withColumn("i", F.row_number().over(ideal)).withColumn("g", gain / F.log2(F.col("i") + 1))
    per_query = best.groupBy("query_id").agg(F.count("*").alias("n_rel"), *[F.sum(F.when(F.col("i") <= k, F.col("g"))).alias(f"ideal_{k}") for k in ks])
    hits = run.filter(F.col("rank") <= depth).join(labelled, ["query_id", "doc_id"]).withColumn("g", gain / F.log2(F.col("rank") + 1))
    of_run = hits.groupBy("query_id").agg(
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"hits_{k}") for k in ks], *[F.sum(F.when(F.col("rank") <= k, F.col("g"))).alias(f"dcg_{k}") for k in ks], F.min("rank").alias("first")
    )
    asked = run.select("query_id").distinct().join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    rows = asked.join(per_query, "query_id", "left").join(of_run, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "query_id",
        *[zero(F.try_divide(F.col(f"hits_{k}"), F.col("n_rel"))).alias(f"recall_{k}") for k in ks],
        zero(1.0 / F.col("first")).alias("rr"),
        *[zero(F.try_divide(F.col(f"dcg_{k}"), F.col(f"ideal_{k}"))).alias(f"ndcg_{k}") for k in ks],
    )


def mean_metrics(per_query: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    measures = [c for c in per_query.columns if c != "query_id" and c not in (by or [])]
    return per_query.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in measures])


def refusal_rates(top: DataFrame, thresholds: DataFrame) -> DataFrame:
    """top: (query_id, score?, answerable). For each threshold: correct, the share of unanswerable refused, and wrong, of answerable refused; null if there are none."""
    refused = (F.coalesce("score", F.lit(0.0)) < F.col("threshold")).cast("double")
    rows = top.crossJoin(F.broadcast(thresholds))  # one for each distinct top score at most: callers give a bounded query set
    return rows.groupBy("threshold").agg(F.avg(F.when(~F.col("answerable"), refused)).alias("correct"), F.avg(F.when(F.col("answerable"), refused)).alias("wrong"))


def threshold_candidates(top: DataFrame, digits: int = 6) -> DataFrame:
    """0 and the midpoints of neighbouring distinct top scores."""
    scores = top.select(F.round(F.coalesce("score", F.lit(0.0)), digits).alias("s")).distinct()
    middle = scores.select(((F.col("s") + F.lead("s").over(Window.orderBy("s"))) / 2).alias("threshold")).filter("threshold is not null")
    return middle.union(middle.sparkSession.range(1).select(F.lit(0.0).alias("threshold"))).distinct()


def best_threshold(rates: DataFrame, most_wrong: float = 0.1) -> DataFrame:
    """The most correct refusals with wrong ones within the limit; the lowest such threshold; 0 if none is."""
    ok = rates.filter((F.coalesce("wrong", F.lit(0.0)) <= most_wrong) & F.col("correct").isNotNull())
    best = ok.agg(F.max_by(F.struct("threshold", "correct", "wrong"), F.struct(F.round("correct", 9), -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce("b.threshold", F.lit(0.0)).alias("threshold"), F.col("b.correct").alias("correct"), F.col("b.wrong").alias("wrong"))


def best_config(grid: DataFrame, keys: list[Column], place: str, by: list[str] | None = None) -> DataFrame:
    """Of each group, the row with the greatest keys; the earlier place wins ties."""
    order = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*[k.desc() for k in keys], place)
    return grid.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def holm(tests: DataFrame, p: str = "p", ties: str = "name", by: list[str] | None = None) -> DataFrame:
    """p_holm: the running maximum of (m - rank) p, at most 1."""
    group = by or [F.lit(1)]
    order = Window.partitionBy(*group).orderBy(p, ties)
    rows = tests.withColumn("r", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*group)))
    step = F.least(F.lit(1.0), (F.col("m") - F.col("r")) * F.col(p))
    return rows.withColumn("p_holm", F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("r", "m")


def _drawn(name: Column, *parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of its parts: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", name, *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def bootstrap_means(diffs: DataFrame, n_boot: int) -> DataFrame:
    """diffs: (i from 0, diff). (b, mean) of each resample of as many values."""
    n = diffs.count()
    draws = diffs.sparkSession.range(n_boot).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    draws = draws.withColumn("i", F.floor(_drawn(F.lit("boot"), F.col("b"), F.col("j")) * n).cast("bigint"))
    return draws.join(F.broadcast(diffs), "i").groupBy("b").agg(F.avg("diff").alias("mean"))  # diffs: one for each query


def bootstrap_interval(diffs: DataFrame, n_boot: int = 10_000) -> DataFrame:
    """(low, high): the means at places int(.025 B) and int(.975 B) - 1 in order."""
    order = F.row_number().over(Window.orderBy("mean", "b")) - 1
    at = lambda i: F.max(F.when(F.col("k") == i, F.col("mean")))
    return bootstrap_means(diffs, n_boot).withColumn("k", order).agg(at(int(0.025 * n_boot)).alias("low"), at(int(0.975 * n_boot) - 1).alias("high"))


def sign_flip(diffs: DataFrame, n_perm: int = 10_000) -> DataFrame:
    """(p): (1 + flips whose mean is as far from 0) / (1 + n_perm)."""
    observed = diffs.agg(F.abs(F.avg("diff")).alias("observed"))
    flips = diffs.sparkSession.range(n_perm).select(F.col("id").alias("b")).crossJoin(F.broadcast(diffs))
    sign = F.when(_drawn(F.lit("flip"), F.col("b"), F.col("i")) < 0.5, 1).otherwise(-1)
    means = flips.groupBy("b").agg(F.abs(F.avg(sign * F.col("diff"))).alias("m"))
    far = F.sum((F.col("m") >= F.col("observed") - 1e-12).cast("int"))
    return means.crossJoin(F.broadcast(observed)).agg(((1 + F.coalesce(far, F.lit(0))) / (1 + n_perm)).alias("p"))


def kappa(pairs: DataFrame, weighted: bool = False, k: int = 3) -> DataFrame:
    """pairs: (x, y). Cohen's kappa, plain or with weights 1 - |x - y| / (k - 1); null if undefined."""
    agree = 1 - F.abs(F.col("x") - F.col("y")) / F.lit(float(k - 1)) if weighted else (F.col("x") == F.col("y")).cast("double")
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("c"))
    total = cells.agg(F.sum("c").alias("n"), F.sum(F.col("c") * agree).alias("o"))
    expected = cells.groupBy("x").agg(F.sum("c").alias("cx")).crossJoin(F.broadcast(cells.groupBy("y").agg(F.sum("c").alias("cy"))))  # one row for each class
    expected = expected.agg(F.sum(F.col("cx") * F.col("cy") * agree).alias("e"))
    both = total.crossJoin(F.broadcast(expected)).select("n", (F.col("o") / F.col("n")).alias("po"), (F.col("e") / (F.col("n") * F.col("n"))).alias("pe"))
    return both.select("n", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def token_f1(pairs: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """F1 of the multisets of tokens; 0 if either is empty or nothing is shared."""
    counted = lambda c, name: pairs.select(key, F.explode(c).alias("t")).groupBy(key, "t").agg(F.count("*").alias(name))
    common = counted(left, "a").join(counted(right, "b"), [key, "t"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("c"))
    rows = pairs.select(key, F.size(left).alias("n"), F.size(right).alias("m")).join(common, key, "left")
    p, r = F.try_divide(F.col("c"), F.col("n")), F.try_divide(F.col("c"), F.col("m"))
    return rows.select(key, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def sus(answers: DataFrame, items: list[str]) -> DataFrame:
    """(participant, sus): 2.5 times the sum of x - 1 for odd items and 5 - x for even ones."""
    parts = [F.col(c) - 1 if i % 2 == 0 else 5 - F.col(c) for i, c in enumerate(items)]
    return answers.select("participant", (2.5 * sum(parts[1:], parts[0])).alias("sus"))


def order_statistics(values: DataFrame, by: str, value: str, places: dict[str, Column], width: float = 0.0005) -> DataFrame:
    """(by, <name>...): the value at a place, from 0, of each group in order; a place is a column of ``n``, the group's rows.

    Sketches tell two values that a place lies between, for each place; values below them are
    counted and only those between them are sorted. Where a sketch is wrong the group is
    sorted whole.
    """
    rows = values.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("__v"))
    n = F.col("n")
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.percentile_approx("__v", [i / 2000 for i in range(2001)], 20_000).alias("cuts"))
    out = sizes.select(by)
    for name, place in places.items():
        share = F.when(n > 1, place / (n - 1)).otherwise(0.0)
        cut = lambda x: F.get("cuts", F.greatest(F.lit(0), F.least(F.lit(2000), x)).cast("int"))
        ends = sizes.select(by, place.cast("bigint").alias("at"), cut(F.floor((share - width) * 2000) - 1).alias("low"), cut(F.ceil((share + width) * 2000) + 1).alias("high"))
        ends = ends.withColumns({"low": F.when(F.col("at") > 0, F.col("low"))})
        marked = rows.join(ends, by).withColumn("under", F.coalesce(F.col("__v") < F.col("low"), F.lit(False)))
        counts = marked.groupBy(by).agg(F.sum(F.col("under").cast("bigint")).alias("before"), F.sum((~F.col("under") & (F.col("__v") <= F.col("high"))).cast("bigint")).alias("inside"), F.first("at").alias("at"))
        counts = counts.withColumn("ok", (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("inside"))).select(by, "before", "ok")
        near = marked.join(counts, by).filter(~F.col("ok") | (~F.col("under") & (F.col("__v") <= F.col("high"))))
        k = F.row_number().over(Window.partitionBy(by).orderBy("__v")) - 1 + F.when(F.col("ok"), F.col("before")).otherwise(0)
        found = near.withColumn("k", k).filter("k = at").select(by, F.col("__v").alias(name))
        out = out.join(found, by, "left")
    return out


def nearest_rank(values: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """The value at place round(share (n - 1)), halves to even, of each group in order."""
    return order_statistics(values, by, value, {"p": F.bround(share * (F.col("n") - 1))})


def medians(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): the middle value of each group, or the mean of the two."""
    n = F.col("n")
    both = order_statistics(values, by, value, {"a": F.floor((n - 1) / 2), "b": F.floor(n / 2)})
    return both.select(by, ((F.col("a") + F.col("b")) / 2).alias("median"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``i``, from 0 in the order of the key; ranges are counted, so no task numbers them all."""
    dealt = rows.repartitionByRange(key).withColumn("__p", F.spark_partition_id())
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))  # a row for each range
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    placed = dealt.withColumn("__nth", nth).join(F.broadcast(before), "__p")
    return placed.withColumn("i", (F.col("__before") + F.col("__nth") - 1).cast("bigint")).drop("__p", "__nth", "__before")


def rule_quality(rows: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """(n_predicted, n_gold, precision, recall) of a boolean rule; null where there is nothing to divide by."""
    both = F.sum((F.col(predicted) & F.col(gold)).cast("bigint"))
    counts = rows.agg(F.sum(F.col(predicted).cast("bigint")).alias("n_predicted"), F.sum(F.col(gold).cast("bigint")).alias("n_gold"), both.alias("both"))
    return counts.select("n_predicted", "n_gold", F.try_divide("both", "n_predicted").alias("precision"), F.try_divide("both", "n_gold").alias("recall"))


def label_pool(first: DataFrame, second: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, doc_id, x, y): two raters' labels (query_id, doc_id, relevance) over their union and all documents of the articles in it; a missing label is 0.

    articles: (doc_id, article).
    """
    labelled = first.select("query_id", "doc_id").union(second.select("query_id", "doc_id")).distinct()
    touched = labelled.join(articles, "doc_id").select("query_id", "article").distinct()
    pool = labelled.union(touched.join(articles, "article").select("query_id", "doc_id")).distinct()
    rated = pool.join(first.withColumnRenamed("relevance", "x"), ["query_id", "doc_id"], "left").join(second.withColumnRenamed("relevance", "y"), ["query_id", "doc_id"], "left")
    return rated.select("query_id", "doc_id", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


def answer_metrics(answers: DataFrame, qrels: DataFrame, f1: DataFrame | None = None) -> DataFrame:
    """(answered, source_ok, source_strict[, mean_f1], correct_refusal, wrong_refusal) of answers (query_id, refused, doc_id, answerable).

    Source rates and F1 (query_id, f1) are means over answered answerable questions.
    """
    rows = answers.join(qrels, ["query_id", "doc_id"], "left")
    rows = rows.join(f1, "query_id", "left") if f1 is not None else rows
    given = F.col("answerable") & ~F.col("refused")
    rate = lambda condition, value: F.avg(F.when(condition, value.cast("double")))
    relevance = F.coalesce("relevance", F.lit(0))
    return rows.agg(
        rate(F.col("answerable"), ~F.col("refused")).alias("answered"), rate(given, relevance > 0).alias("source_ok"), rate(given, relevance == 2).alias("source_strict"),
        *([rate(given, F.coalesce("f1", F.lit(0.0))).alias("mean_f1")] if f1 is not None else []),
        rate(~F.col("answerable"), F.col("refused")).alias("correct_refusal"), rate(F.col("answerable"), F.col("refused")).alias("wrong_refusal"),
    )


def keep_evidence_check(without: DataFrame, with_check: DataFrame, most_wrong: float = 0.1) -> DataFrame:
    """(keep): whether the check refuses no fewer unanswerable questions and stays within the limit. Each input is a row (correct, wrong)."""
    both = without.select(F.col("correct").alias("before")).crossJoin(F.broadcast(with_check.select("correct", "wrong")))
    return both.select(((F.col("correct") >= F.col("before")) & (F.col("wrong") <= most_wrong)).alias("keep"))


def similar_table(suggested: DataFrame, questions: DataFrame, qrels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """For each threshold: coverage, precision at 1, their F1, and the share of unanswerable questions that get a suggestion.

    suggested: (query_id, other_id, score), the best of each; questions: (query_id,
    answerable). A suggestion is right if both share a relevant document.
    """
    relevant = qrels.filter("relevance > 0").select("query_id", "doc_id")
    shared = relevant.join(relevant.select(F.col("query_id").alias("other_id"), "doc_id"), "doc_id").select("query_id", "other_id").distinct().withColumn("right", F.lit(True))
    rows = questions.join(suggested, "query_id", "left").join(shared, ["query_id", "other_id"], "left").crossJoin(F.broadcast(thresholds))
    shown = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    good = F.coalesce(F.col("right"), F.lit(False))
    means = rows.groupBy("threshold").agg(
        F.avg(F.when(F.col("answerable"), shown.cast("double"))).alias("coverage"), F.avg(F.when(F.col("answerable") & shown, good.cast("double"))).alias("precision_at_1"),
        F.avg(F.when(~F.col("answerable"), shown.cast("double"))).alias("shown_unanswerable"),
    )
    p, c = F.col("precision_at_1"), F.col("coverage")
    return means.withColumn("f1", F.coalesce(F.try_divide(2 * p * c, p + c), F.lit(0.0)))


def best_switches(grid: DataFrame, params: dict[str, str], measure: str, place: str = "place") -> DataFrame:
    """The best row of a grid for each combination of switches: params maps names to paths in the JSON column ``params``."""
    rows = grid.withColumns({name: F.get_json_object("params", path) for name, path in params.items()})
    return best_config(rows, [F.round(measure, 6)], place, list(params))
