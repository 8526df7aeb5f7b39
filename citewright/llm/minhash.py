"""Near-duplicate detection: MinHash, banding, verification and connected components.

1. Every text becomes a set of hashed 5-word shingles and 128 minima of it.
2. Texts of equal word sequences are one class, stood for by its smallest key.
3. Classes that agree in all minima of a band share a bucket; each is paired with the
   bucket's smallest. Pairs whose signatures agree enough are confirmed on full sets.
4. Links become components by alternating large-star and small-star steps.
5. Where a bucket still holds several components, members outside its largest are
   compared to all members of the others that their signatures allow: first a few of
   the likeliest as pairs, then the rest inside the bucket, block by block, where only
   links that join components come out. So no link that the bands show is lost, and no
   step makes rows for all pairs of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import as_bytes, cut, join_groups, lowered_words, map_batches, stored, table, text_of, without

SHINGLE = 5
BANDS, ROWS = 32, 4
#: A pair is confirmed on full sets if so large a share of the minima agree. At a similarity
#: of 0.75 the share is below this less than once in a million pairs.
ESTIMATE = 0.55
#: Likeliest partners of a member that are tried as pairs.
LIKELIEST = 4
#: Members of a bucket in a lot; a task compares two lots.
BLOCK = 1024
RESULTS = ("n_shingles", "component_id", "kept")

_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` words; of all words as one run, if fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    run = np.zeros(n, np.uint64)
    for j in range(min(size, len(h))):
        run = (run + h[j : j + n]) * _ODD[j]
    return np.unique(_mix(run))


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each universal hash a x + b (modulo 2^64) over the set."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(out, (_A[:, None] * s[None, at : at + 512] + _B[:, None]).min(axis=1), out=out)
    return out


def signatures(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, n_shingles, same, bands, signature): ``same`` is equal for equal word sequences."""

    def start():
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def run(texts: pa.Array):
            out: list[list] = [[], [], [], []]
            for t in as_bytes(texts):
                words = lowered_words(t)
                s = shingles(words)
                m = minima(s)
                out[0].append(len(s))
                out[1].append(hashlib.md5(b" ".join(words)).digest())
                out[2].append(_mix((m.reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(axis=1, dtype=np.uint64) + band).view(np.int64) if len(s) else [])
                out[3].append((_mix(m) >> np.uint64(48)).astype(np.uint16).tobytes())
            return out

        return run

    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), text_of(text).alias("text"))
    return map_batches(rows, ["key"], [F.col("text")], "n_shingles bigint, same binary, bands array<bigint>, signature binary", start)


def _agreeing(pairs: DataFrame, signature: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures reach ESTIMATE."""
    both = pairs.join(signature.toDF("a", "sa"), "a").join(signature.toDF("b", "sb"), "b")

    def start():
        def run(sa: pa.Array, sb: pa.Array):
            x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(len(s), -1) for s in (sa, sb))
            return [(x == y).mean(axis=1) >= ESTIMATE]

        return run

    return map_batches(both, ["a", "b"], [F.col("sa"), F.col("sb")], "ok boolean", start).filter("ok").drop("ok")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets overlap by ``percent`` of their union or more. texts: (key, text)."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def start():
        last: list = [None, None]

        def run(ta: pa.Array, tb: pa.Array):
            ok = []
            for x, y in zip(as_bytes(ta), as_bytes(tb), strict=True):
                if x != last[0]:
                    last[:] = x, shingles(lowered_words(x))
                s = shingles(lowered_words(y))
                common = len(np.intersect1d(last[1], s, assume_unique=True))
                ok.append(100 * common >= percent * (len(last[1]) + len(s) - common))
            return [ok]

        return run

    return map_batches(both, ["a", "b"], [F.col("ta"), F.col("tb")], "ok boolean", start).filter("ok").drop("ok")


def components(edges: DataFrame) -> DataFrame:
    """(key, component) for every key in edges (a, b): the smallest key reachable, by large-star and small-star."""
    u, v = F.col("u"), F.col("v")
    edges = cut(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = edges.select("u", "v").unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
        large = join_groups(both, least, ["u"], "n", 2 * now[0]).filter("v > u").select(v.alias("u"), F.col("m").alias("v"))
        large = cut(large.filter("u != v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_groups(large, least, ["u"], "n", now[0]).select(v.alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
    found = edges.select(u.alias("key"), v.alias("component"))
    return found.unionByName(edges.select(v.alias("key"), v.alias("component")).distinct())


def _dealt(members: DataFrame) -> DataFrame:
    """members (h, rep, component, ...) by (h, block): every member and, as one that asks for partners, those outside the bucket's largest component.

    Both are dealt into lots of about BLOCK members, and a block is a lot of the one with a
    lot of the other, so no task holds more than two lots of a bucket.
    """
    sizes = members.groupBy("h", "component").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    rows = members.join(buckets, "h").withColumns({"lots": F.ceil(F.col("n") / BLOCK).cast("int"), "asking": F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int")})
    lot, turn = F.pmod(F.xxhash64("rep"), "lots").cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), "asking").cast("int")
    inside = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("a")).withColumns({"block": F.col("a") * F.col("lots") + lot, "asks": F.lit(False)})
    asking = rows.filter("component != main").select("*", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("a")).withColumns({"block": turn * F.col("lots") + F.col("a"), "asks": F.lit(True)})
    return inside.unionByName(asking).drop("main", "most", "n", "lots", "asking", "a")


def _candidates(dealt: DataFrame) -> DataFrame:
    """(h, block, rep, asks, a, b): members with a partner in another component that the signatures allow.

    A pair counts in the first band that it shares only. (a, b) are some of the
    likeliest pairs; other rows have nulls there.
    """

    def find(t: pa.Table) -> pa.Table:
        rep, comp, asks = (t[c].to_numpy() for c in ("rep", "component", "asks"))
        h, block = t["h"][0].as_py(), t["block"][0].as_py()
        sig = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint16).reshape(len(rep), -1)
        bands = t["bands"].combine_chunks().values.to_numpy().reshape(len(rep), BANDS)
        there, needed, pairs = np.flatnonzero(~asks), np.zeros(len(rep), bool), []
        for x in np.flatnonzero(asks):
            others = there[comp[there] != comp[x]]
            share = (sig[others] == sig[x]).mean(axis=1)
            others, share = others[share >= ESTIMATE], share[share >= ESTIMATE]
            shared = bands[others] == bands[x]
            first = shared.argmax(axis=1)
            here = bands[others, first] == h
            others, share = others[here], share[here]
            if len(others):
                needed[x] = needed[others] = True
                likely = others[np.lexsort([rep[others], -share])[:LIKELIEST]]
                pairs += [(min(rep[x], rep[y]), max(rep[x], rep[y])) for y in likely]
        i = np.flatnonzero(needed)
        n, k = len(i), len(pairs)
        none = [None]
        return pa.table(
            [
                pa.array([h] * (n + k), pa.int64()), pa.array([block] * (n + k), pa.int32()), pa.array([*rep[i].tolist(), *none * k], pa.int64()), pa.array([*asks[i].tolist(), *none * k], pa.bool_()),
                pa.array([*none * n, *(int(x) for x, _ in pairs)], pa.int64()), pa.array([*none * n, *(int(y) for _, y in pairs)], pa.int64()),
            ],
            ["h", "block", "rep", "asks", "a", "b"],
        )

    return dealt.groupBy("h", "block").applyInArrow(find, "h bigint, block int, rep bigint, asks boolean, a bigint, b bigint")


def _joining_links(members: DataFrame, percent: int) -> DataFrame:
    """members (h, block, rep, asks, component, text): links (a, b) on full sets between different components, as many as join them."""

    def join(t: pa.Table) -> pa.Table:
        rep, comp, asks = t["rep"].to_numpy(), t["component"].to_pylist(), t["asks"].to_numpy()
        sets = [shingles(lowered_words(x)) for x in as_bytes(t["text"].combine_chunks())]
        sizes = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(ids), np.int32)
        root = {c: c for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for x in np.flatnonzero(asks):
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            common = np.add.reduceat(mark[ids], starts)
            mark[own] = 0
            for y in np.flatnonzero(100 * common >= percent * (sizes + sizes[x] - common)):
                if (cx := find(comp[x])) != (cy := find(comp[y])):
                    root[max(cx, cy)] = min(cx, cy)
                    a.append(min(rep[x], rep[y]))
                    b.append(max(rep[x], rep[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("h", "block").applyInArrow(join, "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75) -> DataFrame:
    """One row for each document: key, n_shingles, component_id and kept.

    A text's set is its distinct runs of five words (A-Z lower-cased), or all its
    words as one run if it has fewer. Texts are linked when their sets overlap by
    ``percent`` of the union or more; a component is what links reach, named by its
    smallest key, whose row is kept. Texts without words (null, empty, white space)
    have empty sets and stand alone. Keys are integers; rows without one stand
    alone, with a null component, and are kept. Rows that share a key are one
    document, with the least of their texts, and give one row. Texts are taken whole. An
    empty table gives no rows. Other columns are not read.

    Bands of four minima, 32 of them, miss a pair at a similarity of 0.75 five times
    in a million, and less above it.
    """
    rows = stored(signatures(df, text, key))
    if rows.groupBy("key").count().filter("count > 1").take(1):
        alone = df.filter(F.col(key).isNull()).select(key, text)
        df = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias(text)).unionByName(alone)
        rows = stored(signatures(df, text, key))
    with_set = rows.filter("n_shingles > 0")
    classes = stored(with_set.groupBy("same").agg(F.min("key").alias("rep"), F.count("*").alias("n")))
    member = stored(join_groups(with_set.select("key", "same"), classes, ["same"], "n", with_set.count()).select("key", "rep"))
    reps = stored(with_set.join(classes.select(F.col("rep").alias("key")), "key", "left_semi").select(F.col("key").alias("rep"), "bands", "signature"))
    spread = reps.select(F.explode("bands").alias("h"), "rep")
    groups = stored(spread.groupBy("h").agg(F.min("rep").alias("lo"), F.count("*").alias("n")).filter("n > 1"))
    star = stored(join_groups(spread, groups, ["h"], "n", BANDS * max(1, reps.count())).select("h", "lo", "rep"))
    signature = reps.select("rep", "signature")
    named = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    texts = stored(named.join(star.select("rep").distinct(), F.col("key") == F.col("rep"), "left_semi"))
    pairs = _agreeing(star.filter("rep != lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct(), signature)
    links = stored(confirm(pairs, texts, percent))
    found = stored(components(links))
    members = _mixed(star, found, reps)
    if members.take(1):
        near = stored(_candidates(_dealt(members)))
        links = stored(links.unionByName(confirm(near.filter("a is not null").select("a", "b").distinct(), texts, percent)))
        found = stored(components(links))
        asked = near.filter("rep is not null").select("h", "block", "rep", "asks")
        named = _named(asked, found)
        several = named.groupBy("h", "block").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("h", "block")
        open_ = named.join(several, ["h", "block"], "left_semi").join(texts.withColumnRenamed("key", "rep"), "rep")
        links = stored(links.unionByName(_joining_links(open_.select("h", "block", "rep", "asks", "component", "text"), percent)))
        found = stored(components(links))
    return _result(df, rows, member, found, key)


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (rep, ...) with the component of each rep."""
    named = rows.join(found.select(F.col("key").alias("rep"), "component"), "rep", "left")
    return named.withColumn("component", F.coalesce("component", "rep"))


def _mixed(star: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """(h, rep, component, signature, bands) of the members of buckets with several components."""
    named = stored(_named(star.select("h", "rep"), found))
    mixed = named.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("h")
    return stored(named.join(mixed, "h", "left_semi").join(reps, "rep").select("h", "rep", "component", "signature", "bands"))


def _result(df: DataFrame, rows: DataFrame, member: DataFrame, found: DataFrame, key: str) -> DataFrame:
    named = member.join(found.select(F.col("key").alias("rep"), "component"), "rep", "left")
    named = named.groupBy("key").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("key", "n_shingles").join(named, "key", "left").withColumn("component_id", F.coalesce("component_id", "key"))
    out = out.withColumn("kept", F.col("key") == F.col("component_id"))
    alone = df.filter(F.col(key).isNull()).select(F.col(key).alias("key"), F.lit(0).cast("bigint").alias("n_shingles"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone).withColumnRenamed("key", key)


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75) -> DataFrame:
    """The rows of df that are kept, as they were; one document of each component."""
    drop = near_duplicates(df, text, key, percent).filter("not kept").select(F.col(key).alias("__key"))
    return df.join(drop, F.col(f"`{key}`") == F.col("__key"), "left_anti")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their components of near duplicates at a similarity of 0.75."""
    return near_duplicates(without(table(spark, sf_dir, "documents").select("doc_id", "text")))
