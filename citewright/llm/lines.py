"""Line deduplication over windows of three consecutive lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import join_groups, stored, table, text_of, without

RESULTS = ("n_lines", "n_removed", "n_spans")


def repeated_lines(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 3) -> DataFrame:
    """(key, gone): the 0-based positions of lines to remove, for the keys that have any.

    Every run of ``window`` consecutive lines is hashed to 128 bits. Its first
    occurrence, by key and then position, stays; each line that a later occurrence
    covers goes. Documents shorter than a window have none.
    """
    lines = F.split(text_of(text), "\n")
    first = F.transform(
        F.sequence(F.lit(0), F.size("lines") - window),
        lambda i: F.struct(i.alias("at"), F.slice("lines", i + 1, window).alias("run")),
    )
    spans = stored(
        df.filter(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), lines.alias("lines"))
        .filter(F.size("lines") >= window)
        .select("key", F.explode(first).alias("w"))
        .select("key", "w.at", F.xxhash64(F.lit(1), "w.run").alias("h"), F.xxhash64(F.lit(2), F.reverse("w.run")).alias("g"))
    )
    repeated = stored(spans.groupBy("h", "g").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = join_groups(spans, repeated, ["h", "g"], "n", spans.count()).filter(F.struct("key", "at") != F.col("first"))
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + window - 1))))
    return later.groupBy(F.col("key").alias(key)).agg(covered.alias("gone"))


def line_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = 3) -> DataFrame:
    """df with the text less its repeated lines, and n_lines, n_removed and n_spans.

    Lines end at a line feed; the lines left are joined by one again. Null text
    counts as empty (one empty line). Rows without a key pass unchanged and count
    for no window. Rows that share a key share the lines removed from either; one place
    in both counts once. A text is taken whole, however
    many lines it has. Input columns named like a result are replaced; the other columns
    are kept as they are. An empty table gives no rows.
    """
    gone = repeated_lines(df, text, key, window).select(F.col(key).alias("__key"), F.col("gone").alias("__gone"))
    base = without(df, *RESULTS)
    rows = base.join(gone, base[f"`{key}`"] == gone["__key"], "left").withColumn("__lines", F.split(text_of(text), "\n"))
    rows = rows.withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    # differences of sets are hashed, so a text costs its lines, whatever goes
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    left = F.transform(kept, lambda i: F.get(F.col("__lines"), i))
    starts = F.array_except(F.col("__gone"), F.transform("__gone", lambda i: i + 1))
    rows = rows.withColumns(
        {
            "n_lines": F.size("__lines").cast("bigint"),
            "n_removed": F.size("__gone").cast("bigint"),
            "n_spans": F.size(starts).cast("bigint"),
            text: F.when(F.size("__gone") > 0, F.array_join(left, "\n")).otherwise(text_of(text)),
        }
    )
    return rows.drop("__key", "__gone", "__lines")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the lines of three-line windows that occurred before, with what was removed."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS run
      FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM d WHERE len(ls) >= 3 AND doc_id IS NOT NULL)),
f AS (SELECT *, count(*) OVER (PARTITION BY run) AS n,
             row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM w),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list([pos, pos + 1, pos + 2])))) AS gone FROM f WHERE k > 1 GROUP BY doc_id),
j AS (SELECT d.doc_id, d.ls, coalesce(g.gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) AS text,
       CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
       CAST(len(list_filter(gone, lambda i: NOT list_contains(gone, i - 1))) AS BIGINT) AS n_spans FROM j
"""
