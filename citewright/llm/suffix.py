"""Removing repeated byte strings with suffix arrays built by induced sorting.

Which strings of LENGTH bytes start earlier elsewhere is found in three steps:

1. Anchors. Every string has an anchor, chosen by its content alone: the 32-byte gram
   inside it with the least hash. So equal strings have equal anchors, and strings
   whose anchor occurs once have no equal. Where the same gram comes back within a string's
   length, as in a row of one letter, repeats close by are found at once.
2. Contexts. Neighbouring strings of one anchor are a run, and its bytes a context.
   Equal contexts are collapsed to the earliest; the others are covered wholly.
3. Shards. Different contexts of the same anchor meet in a shard, less those whose
   bytes tell that they share no string with another. Its suffix array and
   permuted common prefixes give the strings that occur in several of them; all but
   the earliest occurrence are covered. Contexts of an anchor that has very many are cut
   into short ones first, which meet only where the strings of both have most bytes in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import as_bytes, discard, join_groups, map_batches, stored, table, text_of

LENGTH = 100
GRAM = 32
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
#: Bytes of contexts that a shard holds, unless one anchor has more.
SHARD_BYTES = 1 << 20
#: The contexts of an anchor with more different ones are cut into FINE_PARTS.
SHARD_CONTEXTS = 20_000
FINE_PARTS = 23
#: Strings of a text that are worked on together.
SLICE = 1 << 20
#: Parts that the places of an anchor in its strings are dealt into; see _comparable.
PARTS = 4
#: Alphabets up to this size are induced bucket by bucket with array operations.
_ARRAYS_UPTO = 512


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): for each string of ``length`` bytes, the gram inside it with the least hash, the leftmost of equals."""
    n = len(data) - gram + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    h = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        h = (h ^ (words[8 * k : 8 * k + n] * _ODD[k])) * _ODD[(k + 1) % 4]
        h ^= h >> _U(31)
    place = _U((1 << 28) - 1)
    least, span, width = h & ~place | np.arange(n, dtype=np.uint64), 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - width + 1], least[width - span :][: n - width + 1])
    chosen = (least & place).astype(np.int64)
    return chosen, h


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last symbol is the least and alone."""
    differ = np.flatnonzero(t[:-1] != t[1:])
    s = np.ones(len(t), bool)
    runs = np.diff(differ, prepend=-1)
    s[:-1] = np.repeat(t[differ] < t[differ + 1], runs)
    return s


def _induce_arrays(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array from sorted leftmost-smaller suffixes: larger types upwards, then smaller ones downwards.

    Inside a bucket, suffixes induced into the same bucket are handled in rounds.
    """
    count = np.bincount(t, minlength=k)
    start, end = np.cumsum(count) - count, np.cumsum(count)
    sa = np.full(len(t), -1, np.int64)
    of_lms = np.bincount(t[lms], minlength=k)
    lms_end = np.cumsum(of_lms)
    grouped = lms[np.argsort(t[lms], kind="stable")]
    fill = start.copy()

    def put(p: np.ndarray, upward: bool) -> None:
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        c, p = c[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(first, append=len(c))
        within = np.arange(len(c)) - np.repeat(first, sizes)
        if upward:
            sa[fill[c] + within] = p
            fill[c[first]] += sizes
        else:
            sa[fill[c] - 1 - within] = p
            fill[c[first]] -= sizes

    symbols = np.flatnonzero(count)
    for c in symbols:
        at = start[c]
        while at < fill[c]:
            p, at = sa[at : fill[c]] - 1, fill[c]
            p = p[p >= 0]
            put(p[~s[p]], True)
        p = grouped[lms_end[c] - of_lms[c] : lms_end[c]] - 1
        p = p[p >= 0]
        put(p[~s[p]], True)
    larger = fill.copy()
    fill = end.copy()
    for c in symbols[::-1]:
        at = end[c]
        while at > fill[c]:
            p, at = sa[fill[c] : at][::-1] - 1, fill[c]
            p = p[p >= 0]
            put(p[s[p]], False)
        p = sa[start[c] : larger[c]][::-1] - 1
        p = p[p >= 0]
        put(p[s[p]], False)
    sa[0] = len(t) - 1
    return sa


def _induce_lists(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same, symbol by symbol, for large alphabets."""
    count = np.bincount(t, minlength=k)
    start, end = (np.cumsum(count) - count).tolist(), np.cumsum(count).tolist()
    symbols, smaller = t.tolist(), s.tolist()
    sa = [-1] * len(symbols)
    fill = list(end)
    for i in reversed(lms.tolist()):
        fill[symbols[i]] -= 1
        sa[fill[symbols[i]]] = i
    fill = list(start)
    for at in range(len(sa)):
        i = sa[at] - 1
        if i >= 0 and not smaller[i]:
            c = symbols[i]
            sa[fill[c]] = i
            fill[c] += 1
    fill = list(end)
    for at in range(len(sa) - 1, -1, -1):
        i = sa[at] - 1
        if i >= 0 and smaller[i]:
            c = symbols[i]
            fill[c] -= 1
            sa[fill[c]] = i
    sa[0] = len(symbols) - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of integers from 0, the last of which is 0 and the only one. By induced sorting, recursively."""
    k = int(t.max()) + 1
    if len(t) < 3:
        return np.arange(len(t))[::-1]
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    induce = _induce_arrays if k <= _ARRAYS_UPTO else _induce_lists
    if len(lms) > 1:
        # sort leftmost-smaller substrings by inducing from their first symbols, and name them
        rough = induce(t, s, lms, k)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]
        size = np.zeros(len(t), np.int64)
        size[lms] = np.diff(lms, append=len(t))  # to the next one, which counts as well
        a, b = order[:-1], order[1:]
        same = size[a] == size[b]
        pairs = np.flatnonzero(same)
        step = 0
        while len(pairs):
            x, y = a[pairs] + step, b[pairs] + step
            equal = (t[x] == t[y]) & (s[x] == s[y])
            same[pairs[~equal]] = False
            pairs = pairs[equal]
            step += 1
            pairs = pairs[size[a[pairs]] >= step]
            pairs = pairs[(a[pairs] + step < len(t)) & (b[pairs] + step < len(t))]
        names = np.zeros(len(t), np.int64)
        names[order] = np.concatenate([[0], np.cumsum(~same)])
        reduced = names[lms]
        if names[order[-1]] + 1 < len(lms):
            lms = lms[suffix_array(reduced)]
        else:
            lms = order
    return induce(t, s, lms, k)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, wall: int = -1) -> np.ndarray:
    """For each position, the length of the prefix that its suffix shares with the one before it in the array, up to the symbol ``wall``.

    Only irreducible values, where the symbols before the two suffixes differ, are
    compared; the next position's value is one less as long as they agree.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    irreducible = (before < 0) | (at == 0) | (before == 0) | (t[at - 1] != t[before - 1]) | (t[at - 1] == wall)
    i = np.flatnonzero(irreducible)
    j = before[i]
    length = np.zeros(len(i), np.int64)
    alive = np.flatnonzero(j >= 0)
    while len(alive):
        x = t[i[alive] + length[alive]]
        alive = alive[(x == t[j[alive] + length[alive]]) & (x != wall)]
        length[alive] += 1
        alive = alive[np.maximum(i[alive], j[alive]) + length[alive] < n]
    group = np.cumsum(irreducible) - 1
    return np.maximum(length[group] - (at - i[group]), 0)


def later_occurrences(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, position) of each string of ``length`` bytes in a context that occurs earlier in another."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    total = int(sizes.sum()) + len(sizes)
    t = np.ones(total + 1, np.int64)
    t[-1] = 0
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    first = np.cumsum(sizes + 1) - sizes - 1
    inner = np.arange(total) - first[owner]
    t[:-1][inner < sizes[owner]] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 2
    sa = suffix_array(t)
    shared = permuted_prefixes(t, sa, wall=1)
    sa = sa[1:]
    linked = shared[sa] >= length
    whole = inner[sa] + length <= sizes[owner[sa]]
    linked &= whole & np.concatenate([[False], whole[:-1]])
    begins = np.flatnonzero(~linked)
    names, rank = np.unique(docs, return_inverse=True)
    at = starts[owner[sa]] + inner[sa]
    place = rank[owner[sa]].astype(np.int64) << 36 | at
    earliest = np.repeat(np.minimum.reduceat(place, begins), np.diff(begins, append=len(sa)))
    later = whole & (place > earliest)
    return docs[owner[sa[later]]], at[later]


def _spans(docs: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, from, to): strings that overlap or touch, as one span."""
    if not len(docs):
        return docs, at, at
    order = np.lexsort([at, docs])
    docs, at = docs[order], at[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + length)])
    begin = np.flatnonzero(new)
    return docs[begin], at[begin], at[np.append(begin[1:], len(at)) - 1] + length


def _near_repeats(at: np.ndarray, which: np.ndarray, place: np.ndarray, h: np.ndarray, length: int) -> np.ndarray:
    """Which strings equal an earlier one among the strings just before them that have the same gram elsewhere.

    at: place of each string's gram; which: its text; place: where it begins; h: hashes of all grams. Equality
    is that of 128 bits of hash.
    """
    out = np.zeros(len(at), bool)
    moved = (at[1:] != at[:-1]) & (h[at[1:]] == h[at[:-1]]) & (which[1:] == which[:-1])
    if not moved.any():
        return out
    group = np.concatenate([[0], np.cumsum((h[at[1:]] != h[at[:-1]]) | (which[1:] != which[:-1]))])
    loose = np.flatnonzero(np.bincount(group[1:][moved], minlength=group[-1] + 1)[group])
    x, y = (np.zeros(len(loose), np.uint64) for _ in range(2))
    for k, step in enumerate(sorted({*range(0, length - GRAM, GRAM), length - GRAM})):
        gram = h[place[loose] + step]
        x, y = (x ^ gram) * _ODD[k % 4], (y + gram) * _ODD[(k + 1) % 4]
        x, y = x ^ x >> _U(29), y ^ y >> _U(32)
    order = np.lexsort([loose, y, x, group[loose]])
    same = np.concatenate([[False], (group[loose][order][1:] == group[loose][order][:-1]) & (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])])
    out[loose[order[same]]] = True
    return out


def _anchor_rows(df: DataFrame, length: int) -> DataFrame:
    """Runs of strings of one anchor: (key, start, more strings, lead to the anchor, h); lead is -1 for runs that repeat strings close by."""

    def slices(batches):
        group: list[tuple[int, int, bytes]] = []
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for begin in range(0, len(text) - length + 1, SLICE):
                    group.append((key, begin, text[begin : begin + SLICE + length - 1]))
                    held += len(group[-1][2])
                    if held >= SLICE:
                        yield group
                        group, held = [], 0
        if group:
            yield group

    def run(batches):
        for group in slices(batches):
            sizes = np.array([len(x) for _, _, x in group])
            ends = np.cumsum(sizes)
            at, h = anchors(np.frombuffer(b"".join(x for _, _, x in group), np.uint8), length)
            begin = np.arange(len(at))
            which = np.searchsorted(ends, begin, "right")
            inside = np.flatnonzero(begin + length <= ends[which])  # no string spans two texts
            at, which = at[inside], which[inside]
            near = _near_repeats(at, which, inside, h, length)
            # strings that follow one another and have the same gram in the same place are one run
            new = (np.where(near[1:], -1, at[1:]) != np.where(near[:-1], -1, at[:-1])) | (which[1:] != which[:-1]) | (near[1:] != near[:-1])
            first = np.flatnonzero(np.concatenate([[True], new]))
            last = np.append(first[1:], len(inside)) - 1
            keys, bases = (np.array([g[k] for g in group], np.int64) for k in (0, 1))
            base = (bases - ends + sizes)[which[first]]
            lead = np.where(near[first], -1, at[first] - inside[first])
            columns = [keys[which[first]], inside[first] + base, (inside[last] - inside[first]).astype(np.int32), lead.astype(np.int32), h[at[first]].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "start", "more", "lead", "h"])

    return df.mapInArrow(run, "key bigint, start bigint, more int, lead int, h bigint")


def _context_rows(df: DataFrame, length: int) -> DataFrame:
    """df: (key, text, found array<struct<start, more, lead, h>>). The bytes of all strings of each run; lead: where the anchor is in the first."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            held = 0

            def rows(out: list[list]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int32())], ["key", "start", "h", "context", "lead"])

            for key, text, found in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), strict=True):
                x = found.values
                starts, ends = x.field("start").to_pylist(), (x.field("start").to_numpy() + x.field("more").to_numpy() + length).tolist()
                out[0] += [key] * len(starts)
                out[1] += starts
                out[2] += x.field("h").to_pylist()
                out[3] += [text[a:b] for a, b in zip(starts, ends, strict=True)]
                out[4] += x.field("lead").to_pylist()
                held += sum(ends) - sum(starts)
                if held > 8 << 20:
                    yield rows(out)
                    out, held = [[], [], [], [], []], 0
            yield rows(out)

    return df.mapInArrow(run, "key bigint, start bigint, h bigint, context binary, lead int")


def _comparable(rows: list[tuple], length: int) -> list[tuple]:
    """Of the contexts (key, start, h, context, lead), those that can share a string with another of the same anchor.

    In a string an anchor stands at one of length - GRAM + 1 places. The strings of a
    context with the anchor at a place of one part have a core in common, however many
    they are. A context that has no core in common with another of its anchor shares
    no string with any, and need not be sorted.
    """
    reach = length - GRAM
    edges = [(reach + 1) * k // PARTS for k in range(PARTS + 1)]
    seen: dict[tuple[int, int, int], int] = {}
    keys = []
    for _, _, owner, context, lead in rows:
        own = []
        for k in range(PARTS):
            low, high = lead - edges[k + 1] + 1, lead - edges[k]  # where strings with the anchor at these places start
            if high >= 0 and low <= len(context) - length:
                key = (owner, k, xxhash.xxh3_64_intdigest(context[high : low + length]))
                seen[key] = seen.get(key, 0) + 1
                own.append(key)
        keys.append(own)
    return [r for r, own in zip(rows, keys, strict=True) if any(seen[key] > 1 for key in own)]


def _shard_spans(contexts: DataFrame, length: int) -> DataFrame:
    """contexts (key, start, h, context, lead), those of an anchor together and in turn."""

    def run(batches):
        held: list[tuple] = []
        waiting: list[tuple] = []
        size = 0

        def solve():
            docs, starts = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            spans = _spans(*later_occurrences([r[3] for r in held], docs, starts, length), length)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in spans], ["key", "from", "to"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(waiting) > 2000 and row[2] != waiting[-1][2]:
                    chosen = _comparable(waiting, length)
                    waiting.clear()
                    held += chosen
                    size += sum(len(r[3]) for r in chosen)
                    if size > SHARD_BYTES:
                        yield solve()
                        size = 0
                waiting.append(row)
        held += _comparable(waiting, length)
        if held:
            yield solve()

    return contexts.mapInArrow(run, "key bigint, from bigint, to bigint")


def _finer(contexts: DataFrame, length: int) -> DataFrame:
    """contexts (key, start, h, context, lead), each cut into those of its strings that have the anchor in places close together.

    Equal strings have it in the same place. The strings of a cut share all but a few
    bytes, which go into its h: cuts that share no string mostly part.
    """
    reach = length - GRAM
    edges = [(reach + 1) * k // FINE_PARTS for k in range(FINE_PARTS + 1)]

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, at, owner, context, lead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(FINE_PARTS):
                    low, high = lead - edges[k + 1] + 1, lead - edges[k]  # where these strings start
                    a, b = max(0, low), min(len(context) - length, high)
                    if a <= b:
                        name = xxhash.xxh3_64_intdigest(context[high : low + length], seed=(owner + k) & (1 << 64) - 1)
                        for column, v in zip(out, (key, at + a, (name ^ 1 << 63) - (1 << 63), context[a : b + length], lead - a), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["key", "start", "h", "context", "lead"])

    return contexts.mapInArrow(run, "key bigint, start bigint, h bigint, context binary, lead int")


def _met(rows: DataFrame, length: int, finer: bool = True) -> DataFrame:
    """(key, from, to) of strings that start earlier in another of the contexts (key, start, h, context, lead) of the same h."""
    ids = ["h", "x", "y"]
    hashed = rows.select("key", "start", "h", F.xxhash64(F.lit(1), "context").alias("x"), F.xxhash64(F.lit(2), "context").alias("y"), F.length("context").alias("n_bytes"))
    groups = stored(hashed.groupBy(ids).agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")))
    copies = join_groups(hashed, groups.filter("n > 1"), ids, "n", max(1, rows.count())).filter(F.struct("key", "start") != F.col("first"))
    copies = copies.select("key", F.col("start").alias("from"), (F.col("start") + F.col("n_bytes")).alias("to"))
    shards = groups.groupBy("h").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    firsts = groups.join(shards, "h").select("first.key", "first.start", "h", "contexts")
    differing = stored(rows.join(firsts, ["key", "start", "h"]).select("key", "start", "h", "context", "lead", "contexts"))
    here = F.col("contexts") <= SHARD_CONTEXTS if finer else F.lit(True)
    spans = copies.unionByName(_shard_spans(differing.filter(here).drop("contexts").repartition("h").sortWithinPartitions("h"), length))
    large = differing.filter(~here).drop("contexts")
    if finer and large.take(1):
        cut_ = stored(_finer(large, length))
        spans = spans.unionByName(_met(cut_, length, finer=False))
        spans = stored(spans)
        discard(cut_)
    else:
        spans = stored(spans)
    discard(groups, differing)
    return spans


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(key, from, to): bytes covered by strings of ``length`` bytes that start earlier; spans may overlap."""
    docs = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), text_of(text).alias("text"))
    everything = stored(_anchor_rows(docs, length))
    near, found = everything.filter("lead < 0"), everything.filter("lead >= 0")
    total = max(1, found.count())
    several = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    kept = stored(join_groups(found, several, ["h"], "n", total).groupBy("key").agg(F.collect_list(F.struct("start", "more", "lead", "h")).alias("found")))
    discard(several)
    rows = stored(_context_rows(docs.join(kept, "key").select("key", "text", "found"), length))
    discard(kept)
    spans = _met(rows, length).unionByName(near.select("key", F.col("start").alias("from"), (F.col("start") + F.col("more") + length).alias("to")))
    discard(rows)
    return spans


def substring_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, keep: list[str] | None = None, with_bytes: bool = True) -> DataFrame:
    """The columns ``keep`` of df (all but the text, if None) with n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes].

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in
    a smaller key, or earlier in the same text. Strings are judged on the input. What
    stays is bytes: a cut can fall inside a character. Keys are integers; rows
    without one are left whole and not compared; rows that share a key share their
    spans, and one place in both counts once. A null text counts as empty. Texts are taken
    whole, in slices where they are long. An empty table gives no rows; input columns named
    like a result are replaced.
    """
    spans = repeated_spans(df, text, key, length).groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("from", "to")).alias("__spans"))
    spans = stored(spans)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    rows = df.join(spans, F.col(f"`{key}`") == F.col("__key"), "left")

    def start():
        def run(texts: pa.Array, found: pa.Array):
            out: list[list] = [[], [], [], [], []]
            for t, pairs in zip(as_bytes(texts), found, strict=True):
                spans: list[list[int]] = []
                if pairs.is_valid:
                    x = pairs.values
                    for a, b in sorted(zip(x.field("from").to_pylist(), x.field("to").to_pylist(), strict=True)):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        elif a < len(t):
                            spans.append([a, b])
                left = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)], strict=True))
                for column, v in zip(out, (len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                    column.append(v)
            return out if with_bytes else out[:4]

        return run

    fields = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * with_bytes
    return map_batches(rows, keep, [text_of(text), F.col("__spans")], fields, start)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents less the bytes of 100-byte strings that start earlier, as counts and a digest of what stays."""
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], with_bytes=False)
