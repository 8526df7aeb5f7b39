"""Query log and feedback: history, summaries and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last rating of each query (query_id, rating, comment, time, seq): latest wins. Only -1 and 1 are ratings."""
    order = Window.partitionBy("query_id").orderBy(F.desc("time"), F.desc("seq"))
    return feedback.filter(F.col("rating").isin(-1, 1)).withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def history(queries: DataFrame, feedback: DataFrame, limit: int = 500, keyword: str | None = None) -> DataFrame:
    """The last queries with their rating, newest first; with a keyword (a regular expression, any case) those that match."""
    rows = queries if keyword is None else queries.filter(F.col("question").rlike(f"(?iu){keyword}"))
    last = rows.orderBy(F.desc("id")).limit(limit)
    return last.join(latest_feedback(feedback).select(F.col("query_id").alias("id"), "rating", "comment"), "id", "left")


def summary(queries: DataFrame, feedback: DataFrame) -> DataFrame:
    """(total, refused, up, down)."""
    rated = latest_feedback(feedback).agg(F.coalesce(F.sum((F.col("rating") == 1).cast("bigint")), F.lit(0)).alias("up"), F.coalesce(F.sum((F.col("rating") == -1).cast("bigint")), F.lit(0)).alias("down"))
    return queries.agg(F.count("*").alias("total"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused")).crossJoin(F.broadcast(rated))  # a row each


def value_counts(rows: DataFrame, value: Column, name: str, n: int | None = None) -> DataFrame:
    counted = rows.select(value.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("count"))
    return counted if n is None else counted.orderBy(F.desc("count"), name).limit(n)


def per_day(rows: DataFrame, time: str = "time") -> DataFrame:
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("count"))


def score_bars(sources: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Width of each source's bar: 15 to 100 between the least and the greatest score of its list; 100 if all are equal."""
    ends = sources.groupBy(by).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    width = F.when(high == low, 100.0).otherwise(15 + 85 * (F.col(score) - low) / (high - low))
    return sources.join(ends, by, "left").withColumn("width", width).drop("__low", "__high")


def seeded_order(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in an order that follows from the seed alone."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def per_topic(questions: DataFrame, topic: Column, accented: Column, most: int = 5) -> DataFrame:
    """(topic, query_id, group_id, place): accented questions first, then by id; one of a group, ``most`` of a topic."""
    rows = questions.withColumns({"topic": topic, "plain": (~accented).cast("int")})
    one = Window.partitionBy("group_id").orderBy("plain", "query_id")
    rows = rows.withColumn("g", F.row_number().over(one)).filter("g = 1")
    place = F.row_number().over(Window.partitionBy("topic").orderBy("plain", "query_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("topic", "query_id", "group_id", "place")
