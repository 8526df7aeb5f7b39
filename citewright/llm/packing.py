"""Packing documents into sequences of bounded length by bin completion.

Tokens are counted once, in parallel. What packing needs of all documents is only
how many pieces have each length, at most ``capacity`` numbers; fillings are searched
for over these counts on the driver, and each piece then takes its place by its rank
among the pieces of its length.
"""

from __future__ import annotations

import base64
import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citewright.llm.common import cut, prepare, table, text_of

END_ID = 2
CAPACITY = 1024
#: Nodes of the search for a packing better than best-fit decreasing; None searches to the end.
NODES = 3000
#: Dominated fillings that count as a node.
TICK = 100
#: Pieces of one length that are ranked together.
BUCKET_ROWS = 1000


def encoder(ranks_path: str | None = None, json_path: str | None = None):
    """text -> ids as ``tokenizers`` gives them for byte_bpe_50k.json with add_special_tokens=False.

    The JSON file says which strings are special; like there, they become their own id
    inside a text. The vocabulary is read from the ranks file by the library that encodes it
    five times faster; the few texts that overflow its pattern's stack, such as a million
    spaces in a row, go to ``tokenizers``. Paths default to those of public_tokenizers.
    """
    import public_tokenizers
    import tiktoken

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    with open(json_path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    whole: list = []

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all") if any(t in text for t in special) else fast.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
        if not whole:
            from tokenizers import Tokenizer

            whole.append(Tokenizer.from_file(json_path))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def pieces(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, paths: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): each document's tokens and end id, cut where longer than capacity.

    The first piece takes what is left over, so that all others are full. A null
    text counts as empty and is one piece of the end id alone.
    """
    prepare(df.sparkSession)
    source = df.select(F.col(f"`{key}`").alias("key"), text_of(text).alias("text"))
    schema = StructType([source.schema["key"], *StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)])

    def run(batches):
        import pyarrow as pa

        encode = encoder(*paths)
        for batch in batches:
            rows: list[list] = [[] for _ in schema.names]
            for key_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(t), END_ID], "<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : at + capacity] if k else ids[:first]
                    for column, v in zip(rows, (key_, k, at, len(part), zlib.crc32(part.tobytes()), part), strict=False):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, batch.schema.field(0).type) if i == 0 else pa.array(c) if i > 1 else pa.array(c, pa.int32()) for i, c in enumerate(rows)], schema.names)

    return source.mapInArrow(run, schema).toDF(key, *schema.names[1:])


def lower_bound(left: np.ndarray) -> int:
    """Bins that pieces need at least; left[s] pieces of size s, sizes up to len(left) - 1 = capacity.

    For every k: pieces above capacity - k stand alone, those above half each need a bin,
    and what pieces from k up to half do not fit into the rest of these is their waste bound.
    """
    capacity = len(left) - 1
    sizes = np.arange(capacity + 1)
    n, total = np.cumsum(left), np.cumsum(left * sizes)
    half = capacity // 2
    k = np.arange(half + 1)
    big = n[capacity] - n[half]  # one bin each
    room = (n[capacity - k] - n[half]) * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int(big + max(0, np.max(-((room - small) // capacity))))


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (filling, how often), all pieces of one size at a time."""
    capacity = len(left) - 1
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {capacity: []}  # room -> fillings with that room
    rooms = [capacity]  # rising; the last stands for new bins
    for s in np.flatnonzero(left)[::-1].tolist():
        n, put = int(left[s]), []
        at = bisect.bisect_left(rooms, s)
        while n:
            room = rooms[at]
            most = room // s
            if room == capacity:
                taken = [((), n // most)] + [((), 1)] * (n % most > 0)
            else:
                taken = open_.pop(room)
                rooms.pop(at)
            for i, (use, bins) in enumerate(taken):
                whole = min(bins, n // most)
                if whole:
                    put.append((room - most * s, (*use, *[s] * most), whole))
                    n -= whole * most
                    bins -= whole
                if bins and n:  # the last few
                    put.append((room - n * s, (*use, *[s] * n), 1))
                    bins, n = bins - 1, 0
                if bins:
                    put.append((room, use, bins))
                if not n:
                    put += [(room, *rest) for rest in taken[i + 1 :] if room < capacity]
                    break
        for room, use, bins in put:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((use, bins))
    return [x for fillings_ in open_.values() for x in fillings_]


def fillings(left: np.ndarray, space: int, least: int) -> Iterator[tuple[int, ...] | None]:
    """Undominated fillings of a space with a sum of ``least`` or more, by rising waste, large pieces first.

    A filling is dominated where a piece left out could take the place of one or several of
    its pieces that are smaller together, or as large and several: a packing that uses it
    becomes one that uses the other by an exchange. None is skipped that no other dominates.
    After TICK dominated ones in between, None comes, so that a bounded search can end there.
    """
    sizes = np.flatnonzero(left[: space + 1])[::-1].tolist()
    if not sizes:
        if least <= 0:
            yield ()
        return
    mask = (1 << space + 1) - 1
    reach = [1]  # sums of sizes[i:], from the end, as bits
    for s in reversed(sizes):
        r = reach[-1]
        for _ in range(min(int(left[s]), space // s)):
            more = (r | r << s) & mask
            if more == r:
                break
            r = more
        reach.append(r)
    reach.reverse()
    present = sum(1 << s for s in sizes)

    def dominated(use: list[int], waste: int) -> bool:
        sums, several = 0, 0  # of one or more pieces, of two or more
        for s in use:
            several |= several << s | sums << s
            sums |= sums << s | 1 << s
        swaps, span = sums << 1, 1  # by 1 to waste more
        while span < waste:
            step = min(span, waste - span)
            swaps |= swaps << step
            span += step
        out = present
        for s in set(use):
            if use.count(s) == left[s]:
                out &= ~(1 << s)
        return bool(out & (several | (swaps if waste else 0)))

    dropped = 0
    for target in range(space, max(least, 0) - 1, -1):
        if not reach[0] >> target & 1:
            continue
        use: list[int] = []
        stack = [(0, target)]  # next size to try, what is left to reach
        while stack:
            i, rest = stack.pop()
            if rest == 0:
                if not dominated(use, space - target):
                    yield tuple(use)
                elif (dropped := dropped + 1) % TICK == 0:
                    yield None
                if use:
                    use.pop()
                continue
            while i < len(sizes) and not (sizes[i] <= rest and reach[i] >> rest & 1):
                i += 1
            if i == len(sizes):
                if use:
                    use.pop()
                continue
            s = sizes[i]
            stack.append((i + 1, rest))
            if use.count(s) < left[s]:
                use.append(s)
                stack.append((i, rest - s))


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for so many pieces of each size, in as few bins as the search finds.

    Bin completion: best-fit decreasing is the first incumbent. Depth first, the largest
    piece left is completed by each undominated filling, by rising waste, used as often as the
    counts allow or once; so every packing of undominated fillings is met. A node is cut
    where its waste or the bound of what is left makes it no better than the incumbent,
    or where the same pieces were left before for no more bins. The search ends when the
    incumbent meets the bound, or after ``nodes`` nodes; with None it is exact.
    """
    start = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        start[s] += n
    total = int(start @ np.arange(capacity + 1))
    best = best_fit(start)
    bins = sum(n for _, n in best)
    bound = lower_bound(start)
    if bins <= bound:
        return best
    path: list[tuple[tuple[int, ...], int]] = []
    seen: dict[bytes, int] = {}
    done = 0

    def options(left: np.ndarray, used: int, waste: int):
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        allowed = (bins - 1) * capacity - total - waste  # waste that an improvement can still bear
        for chosen in fillings(left.copy(), capacity - top, capacity - top - allowed):
            if chosen is None:
                yield None
                continue
            use = (top, *chosen)
            spare = capacity - sum(use)
            after = left.copy()
            after[top] += 1
            times = min(int(after[s]) // use.count(s) for s in set(use))
            allowed = (bins - 1) * capacity - total - waste
            if spare > allowed:
                return
            if spare:
                times = min(times, allowed // spare)
            for t in (times, 1) if times > 1 else (1,):
                next_ = after.copy()
                for s in use:
                    next_[s] -= t
                yield use, t, next_, used + t, waste + t * spare

    stack = [options(start.copy(), 0, 0)]
    while stack and bins > bound and (nodes is None or done < nodes):
        step = next(stack[-1], ())
        if step == ():
            stack.pop()
            if path:
                path.pop()
            continue
        done += 1
        if step is None:
            continue
        use, times, left, used, waste = step
        if not left.any():
            if used < bins:
                best, bins = [*path, (use, times)], used
            continue
        key = left.tobytes()
        if used + lower_bound(left) >= bins or seen.get(key, bins) <= used:
            continue
        seen[key] = used
        path.append((use, times))
        stack.append(options(left, used, waste))
    return best


def runs(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: ranks at which runs of places begin, the sequence of the first, and the offset in a sequence."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for use, times in packed:
        offset = 0
        for s in use:
            out.setdefault(s, []).append((used.get(s, 0), base, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        base += times
    return {s: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for s, x in out.items()}


def place(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS, nodes: int | None = NODES) -> DataFrame:
    """parts (key, piece, length, ...) with sequence_id and offset; parts should be cheap to read twice.

    Full pieces are sequences of their own. The others are ranked among those of their
    length, which hash buckets of about ``bucket_rows`` share out, more for a common length.
    """
    spark = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # capacity rows at most
    full = histogram.pop(capacity, 0)
    packed = pack_counts(histogram, capacity, nodes)
    places = spark.sparkContext.broadcast(runs(packed))
    bins = sum(n for _, n in packed)
    buckets = F.element_at(F.array(*[F.lit(1 + histogram.get(s, 0) // bucket_rows) for s in range(1, capacity + 1)]), F.col("length").cast("int"))
    rest = parts.filter(F.col("length") < capacity).withColumn("__bucket", F.pmod(F.xxhash64(F.col(f"`{key}`"), "piece"), buckets))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rest.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(key, "piece"))
    ranked = rest.withColumn("__rank", rank).join(offsets, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before") - 1)
    columns = parts.columns
    ranked = ranked.select(*columns, F.col("__rank").cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    names = ranked.columns

    def run(batches):
        import pyarrow as pa

        table_ = places.value
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            rank_ = b.column(names.index("sequence_id")).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                lo, base, off = table_[int(s)]
                k = np.searchsorted(lo, rank_[at], "right") - 1
                sequence[at], offset[at] = base[k] + rank_[at] - lo[k], off[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(sequence), pa.array(offset)], names)

    out = ranked.mapInArrow(run, ranked.schema)
    if full:
        whole = parts.filter(F.col("length") == capacity)
        out = out.unionByName(whole.withColumns({"sequence_id": F.lit(bins) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")}))
    return out


def pack(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, paths: tuple[str, ...] = (), nodes: int | None = NODES) -> DataFrame:
    """One row for each piece of each document: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty; null and repeated keys are packed like others; a very long
    text becomes many pieces, all in one task. An empty table gives no rows. Other columns
    of df are not read. ``nodes`` limits the search, which never ends above best-fit decreasing.
    """
    return place(cut(pieces(df, text, key, capacity, paths)), key, capacity, nodes=nodes)


def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens by bin completion; one row for each piece."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
