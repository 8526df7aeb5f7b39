"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

Pass one marks, for every row, a few cells of a filter and keeps the cells that at
least two rows marked. Pass two tests each row against those cells: a row with an
unshared cell has no equal and passes straight through; only the others shuffle.
A filter holds at most ``max_bits`` bits. More rows than it serves are dealt by a prefix
of the digest into ranges, each of which has a filter of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import cut, join_groups, stored, table, text_of, without

SPACE_RUN = r"[\x20\x09-\x0D]+"
_BLOCK_WORDS = 1024  # a block of the filter: 1024 words of 64 bits


def filter_sizes(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 28) -> tuple[int, int]:
    """(ranges, bits of each range's filter): bits_per_row a row or more; a power of two from one block to max_bits."""
    ranges = max(1, -(-rows * bits_per_row // max_bits))
    bits = 1 << 16
    while bits * ranges < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return ranges, bits


def _cells(digest: Column, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) for k in range(hashes)]


def repeated_cells(rows: DataFrame, digest: str, bits: int, hashes: int) -> DataFrame:
    """One row: the cells marked twice or more, as an array of blocks of 64-bit words."""
    cell = F.explode(F.array(*_cells(F.col(digest), bits, hashes))).alias("cell")
    shared = rows.select(cell).groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    words = shared.groupBy(
        F.shiftright("cell", 16).alias("block"), (F.shiftright("cell", 6) % _BLOCK_WORDS).alias("word")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits"))
    dense = lambda count, entries, none: F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.coalesce(F.try_element_at(entries, i.cast("bigint")), none),
    )
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    blocks = words.groupBy("block").agg(entries("word", "bits").alias("m"))
    blocks = blocks.select("block", dense(_BLOCK_WORDS, F.col("m"), F.lit(0).cast("bigint")).alias("words"))
    empty = F.array().cast("array<bigint>")
    return blocks.agg(entries("block", "words").alias("m")).select(dense(bits >> 16, F.col("m"), empty).alias("filter"))


def _marked(shared: Column, cell: Column) -> Column:
    words = F.get(shared, F.shiftright(cell, 16).cast("int"))
    word = F.coalesce(F.get(words, (F.shiftright(cell, 6) % _BLOCK_WORDS).cast("int")), F.lit(0).cast("bigint"))
    return F.call_function("getbit", word, (cell % 64).cast("int")) == 1


def _tested(rows: DataFrame, bits: int, hashes: int) -> DataFrame:
    """rows with ``maybe``: whether all its cells are marked twice or more. The filter is stored first, at most ``bits``."""
    shared = cut(repeated_cells(rows, "text_sha256", bits, hashes))
    maybe = F.lit(True)
    for cell in _cells(F.col("text_sha256"), bits, hashes):
        maybe = maybe & _marked(shared.scalar(), cell)
    return rows.withColumn("maybe", maybe)


def exact_groups(
    df: DataFrame, text: str = "text", key: str = "doc_id", *, bits_per_row: int = 16, max_bits: int = 1 << 28, hashes: int = 2
) -> DataFrame:
    """One row for each row of df: its group of equal texts and whether it stays.

    Texts are equal when they are after each run of white space became one space;
    they are compared by SHA-256. The smallest key of a group stays. A null text
    counts as empty. Rows that repeat a key with the same text are all marked
    kept, as the decision is on the key; a null key stays only in a group that has
    no other. Texts are taken whole. An empty table gives no rows; other columns of df
    are not read.
    """
    digest = F.sha2(F.regexp_replace(text_of(text), SPACE_RUN, " "), 256)
    rows = cut(df.select(F.col(key).alias("key"), digest.alias("text_sha256")))
    total = rows.count()
    ranges, bits = filter_sizes(total, bits_per_row, max_bits)
    if ranges > 1:  # one folder for each range, so that each is read alone; no shuffle
        rows = stored(rows.withColumn("range", F.pmod(F.xxhash64("text_sha256", F.lit("range")), F.lit(ranges)).cast("int")), "range")
    tested = [_tested(rows if ranges == 1 else rows.filter(F.col("range") == r).drop("range"), bits, hashes) for r in range(ranges)]
    rows = reduce(DataFrame.unionByName, tested)
    shuffled = rows.filter("maybe").drop("maybe")
    groups = cut(shuffled.groupBy("text_sha256").agg(F.min("key").alias("keep_id"), F.count("*").alias("group_size")))
    several = join_groups(shuffled, groups, ["text_sha256"], "group_size", total)
    alone = rows.filter("not maybe").withColumns({"keep_id": F.col("key"), "group_size": F.lit(1).cast("bigint")})
    columns = [F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return several.select(columns).unionByName(alone.select(columns))


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that stay, with all their columns; rows without a key stay too."""
    drop = exact_groups(df, text, key).filter(f"not kept and `{key}` is not null").select(key)
    return df.join(drop, key, "left_anti")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their groups of equal texts; the smallest doc_id of each stays."""
    return exact_groups(without(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
