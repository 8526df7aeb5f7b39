"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in whole texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import as_bytes, map_batches, table, text_of, without

#: What separates words, beside white space: every ASCII character but letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
RESULTS = ("n_words", "n_hit", "items", "spans")
#: Windows searched for in one pass; more are dealt to further passes.
WINDOWS_A_PASS = 500_000


def fold(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class WuManber:
    """Search for many strings at once.

    Over the first ``m`` bytes of every pattern (m: the shortest length), SHIFT has
    for each block of ``b`` bytes how far the window may move on; a block unknown to
    it moves by m - b + 1. At shift 0 the window's last block selects the bucket of
    patterns to compare directly.
    """

    def __init__(self, patterns: list[bytes], block: int = 10):
        self.m = min(map(len, patterns))
        self.b = min(block, max(1, self.m - 2))
        self.far = self.m - self.b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(self.b, self.m + 1):
                x = p[end - self.b : end]
                self.shift[x] = min(self.m - end, self.shift.get(x, self.far))
            self.bucket[p[self.m - self.b : self.m]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        m, b, far, shift, end, n = self.m, self.b, self.far, self.shift.get, self.m, len(text)
        while end <= n:
            block = text[end - b : end]
            move = shift(block, far)
            if not move:
                for p in self.bucket[block]:
                    if text.startswith(p, end - m):
                        yield end - m, p
                move = 1
            end += move


class Searcher:
    """Windows by length class, so that a few short ones don't shorten the shifts for all."""

    CLASSES = (8, 16, 32, 1 << 60)

    def __init__(self, windows: dict[bytes, list[str]]):
        classes = defaultdict(list)
        for w in windows:
            p = b" " + w + b" "
            classes[next(c for c in self.CLASSES if len(p) < c)].append(p)
        self.windows, self.searches = windows, [WuManber(x) for x in classes.values()]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word positions [from, to) of each occurrence, and the items that occur."""
        text = b" " + b" ".join(words) + b" "
        found = [x for s in self.searches for x in s.find(text)]
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first = np.searchsorted(spaces, [at for at, _ in found]).tolist()
        spans = [(i, i + p.count(b" ") - 1) for i, (_, p) in zip(first, found, strict=True)]
        return spans, {item for p in {p for _, p in found} for item in self.windows[p[1:-1]]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_windows(items: DataFrame, text: str, item: str, size: int) -> DataFrame:
    """(window, item): every run of ``size`` words of an item, or all its words if fewer."""
    words = F.regexp_extract_all(F.translate(text_of(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = items.select(F.col(item).cast("string").alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))
    return rows.select(F.explode(runs).alias("window"), "item").distinct()


def search(df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id", size: int = 10, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all, if None) with n_words, n_hit, items and spans.

    Words are runs of letters, digits and characters above ASCII, A-Z lower-cased. A
    window is ``size`` consecutive words of an item, or all its words if it has
    fewer; words inside any occurrence of a window are hit. ``items`` has the ids,
    as sorted strings, of items with a window that occurs (a null id as ""), and
    ``spans`` the merged word positions, from and to in turn. Null and empty texts
    have no words; items without words have no windows; without windows nothing is
    hit. Input columns named like a result are replaced.

    The windows go to the executors in passes of WINDOWS_A_PASS, one after another
    over the same rows, so what is broadcast is bounded whatever the benchmark.
    """
    spark = df.sparkSession
    windows = item_windows(items, item_text, item, size).withColumn("item", F.coalesce("item", F.lit("")))
    passes = max(1, -(-windows.count() // WINDOWS_A_PASS))
    df = without(df, *RESULTS)
    keep = df.columns if keep is None else keep
    rows = df.withColumns({"__text": text_of(text), "n_words": F.lit(0).cast("bigint"), "n_hit": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<bigint>")})
    for k in range(passes):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(passes)) == k).collect()
        by_window: dict[bytes, list[str]] = defaultdict(list)
        for r in part:
            by_window[r["window"].encode()].append(r["item"])
        rows = _pass(rows, keep, spark.sparkContext.broadcast(dict(by_window)), last=k == passes - 1)
    return rows


def _pass(rows: DataFrame, keep: list[str], windows, last: bool) -> DataFrame:
    def start():
        searcher = Searcher(windows.value)

        def run(texts: pa.Array, items: pa.Array, spans: pa.Array):
            out = [[], [], [], []]
            for text, had, old in zip(as_bytes(texts), items.to_pylist(), spans.to_pylist(), strict=True):
                words = fold(text)
                new, ids = searcher.hits(words) if windows.value and words else ([], set())
                new = merged([*new, *zip(old[::2], old[1::2], strict=True)])
                out[0].append(len(words))
                out[1].append(sum(b - a for a, b in new))
                out[2].append(sorted({*had, *ids}))
                out[3].append([x for s in new for x in s])
            return out if last else [texts, *out]

        return run

    fields = "n_words bigint, n_hit bigint, items array<string>, spans array<bigint>"
    inputs: list[Column] = [F.col("__text"), F.col("items"), F.col("spans")]
    return map_batches(rows, keep, inputs, fields if last else f"__text string, {fields}", start)


def decontaminate(df: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of df in which no window of any item occurs, as they were."""
    columns = df.columns
    return search(df, items, **how).filter("n_hit = 0").select([F.col(f"`{c}`") for c in columns])


def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Words joined by one space, so that a window occurs where its padded string does.
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS run
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
s AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS run
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.k, s.n, p.item_id FROM s JOIN p USING (n, run)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS x FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(t.x, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
