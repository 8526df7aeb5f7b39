"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is a sequence of lower-cased words and one end. A token is coded in bits: by a prefix
code of the frequent words, or as the code's escape and then its bytes and a terminator, each by
the prefix code of bytes after the byte before. Every bit is predicted from hashed contexts: of a
word the code so far alone, the kind of text, the last bytes, the last word and the last two words
before it; of a byte the two to four bytes before it, which may belong to the word before, the
word so far, and this with the word before. The predictions are mixed in the logistic domain by
weights that a gate selects, and an adaptive map refines the mix. What is learned:

* counts of every training word (a distributed aggregate);
* in one online pass over the texts of each partition: weights and map, each block of bits being
  predicted before its counts are added, and tables of bit counts. The partitions' tables are
  added, their weights averaged.

A word that is spelled may also be one that the training texts have: its probability is that of
its spelling and its share of all spelled training words, weighed by how many of these occur once.

Tables have as many slots as training tokens, to the next power of two and at most
2**SLOT_BITS, twice as many for the two longest contexts; only they and the frequent words,
at most HEAD, are broadcast. RUN bits of a code that
follow one another have their slots in one row of 2**RUN, in an order that the context picks, so
that they are found in one line of memory.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import as_bytes, map_batches, remainder, stored, table, text_of

#: The end, which no word equals.
END = b"\n"
KINDS = 8
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
#: The most words that have a code of their own, and the training tokens for each.
HEAD, TOKENS_A_WORD = 1 << 18, 64
#: Rarer words are spelled, so that spelling is learned from words like those not seen yet.
HEAD_LEAST = 3
#: Limits of the table sizes, and training tokens of a learning task: its table is written once.
LEAST_SLOT_BITS, SLOT_BITS = 16, 21
TASK_TOKENS = 1 << 23
#: Bytes before a word that its spelling sees.
TAIL = 4
PREDICTORS = 5
CHUNKS = 32
#: Bytes of text scored together, of words counted together, and tokens and spelled words whose bits are worked out together.
BLOCK_BYTES, COUNTED_BYTES, TOKENS, SPELT = 1 << 21, 1 << 25, 2048, 512
#: Bits of a code whose slots lie in one row of 2**RUN. Contexts that meet do so with whole rows: at 6 scoring is faster, and a token costs 0.003 more in log10.
RUN = 3
_PRIOR = 0.4
_BUCKETS = 33
_LEVELS = 4
_GATES = 2 * _LEVELS * _LEVELS
_U, _V = np.uint64, np.uint32
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_NODE, _SLOT = _V(0x9E3779B1), _V(0x85EBCA6B)
#: An odd number and what it gives 1 with, modulo 2**64.
_POWER = 0x9E3779B97F4A7C15
_INVERSE = pow(_POWER, -1, 1 << 64)


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
#: Of each run, as its bits after a leading one, and each of its bits: twice the place in the row, and the bit.
_PLACES = np.array([[(1 << j | run >> n - j & (1 << j) - 1) * 2 + (run >> n - 1 - j & 1) if j < n else 0 for j in range(RUN)] for run in range(2 << RUN) for n in [run.bit_length() - 1]]).ravel()


def kind_of(word: bytes) -> int:
    """The kind of text that a word shows by its first character above ASCII; it has one."""
    i = next(i for i, b in enumerate(word) if b > 127)
    return 1 + (word[i] * 31 + (word[i + 1] if i + 1 < len(word) else 0)) % (KINDS - 1)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for symbols of such counts. Very small counts are raised, so that none is longer than 30."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    counts = np.maximum(counts, max(1, int(counts.sum()) >> 27))
    order = np.argsort(counts, kind="stable")
    leaves, inner, parent = counts[order].tolist(), [], [0] * (2 * n - 1)
    i = j = 0
    for node in range(n, 2 * n - 1):  # the two least of both queues
        weight = 0
        for _ in range(2):
            if j >= len(inner) or (i < n and leaves[i] <= inner[j]):
                weight, parent[i], i = weight + leaves[i], node, i + 1
            else:
                weight, parent[n + j], j = weight + inner[j], node, j + 1
        inner.append(weight)
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of such lengths, each after a leading one; symbols of one length follow one another."""
    order = np.argsort(lengths, kind="stable")
    sorted_ = lengths[order]
    longest = int(sorted_[-1])
    # as fractions of the longest code, each begins where the one before ends
    step = np.left_shift(1, longest - sorted_)
    begin = np.cumsum(step) - step
    out = np.empty(len(lengths), np.uint32)
    out[order] = (begin >> (longest - sorted_)) | np.left_shift(1, sorted_)
    return out


@dataclass
class Runs:
    """Codes in runs of RUN bits; the last of a code may have fewer."""

    symbol: np.ndarray  # of each run
    nodes: np.ndarray  # hash of the code before it
    run: np.ndarray  # of each bit
    place: np.ndarray  # in the row
    bits: np.ndarray
    begins: np.ndarray  # each symbol's first bit
    rows: list[np.ndarray]  # of each predictor, the slot of place 0 of each run

    @classmethod
    def of(cls, codes: np.ndarray, lengths: np.ndarray) -> Runs:
        """Codes with a leading one."""
        counts = (lengths + (RUN - 1)) // RUN
        ends = np.cumsum(counts)
        symbol = np.repeat(np.arange(len(lengths)), counts)
        left = (lengths + RUN * (ends - counts)).take(symbol)
        left -= np.arange(0, RUN * len(symbol), RUN)  # bits from the run on
        sizes = np.minimum(left, RUN)
        code = codes.take(symbol)
        nodes = (code >> left.astype(np.uint32)) * _NODE
        upto = (code >> (left - sizes).astype(np.uint32)).astype(np.int64)
        one = np.left_shift(1, sizes)
        begin = (upto & (one - 1) | one) * RUN
        begin -= np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(len(symbol)), sizes)
        place = begin.take(run)
        place += np.arange(len(run))
        place = _PLACES.take(place)
        bits = place & 1
        place >>= 1
        return cls(symbol, nodes, run, place, bits, np.cumsum(lengths) - lengths, [])

    def slots(self, k: int) -> np.ndarray:
        """The slot of each bit for a predictor, made where it is used: a block's slots of all predictors do not fit a core's cache."""
        slots = self.rows[k].take(self.run)
        slots ^= self.place
        return slots


def _tail(word: bytes) -> int:
    """The last bytes of a text that ends with the word and a space."""
    return int.from_bytes((word + b" ")[-TAIL:].rjust(TAIL, b"\0"), "little")


def _later(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What x is for the token before; 0 for the first of a text."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = 0
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """32 well-mixed bits of 64."""
    x = (x + _U(salt)) * _ODD[0]
    x = (x ^ (x >> _U(29))) * _ODD[1]
    return (x >> _U(32)).astype(np.uint32)


class Coder:
    """Tokens to bits and the slots that predict them."""

    def __init__(self, head: list[bytes], counts: list[int], rest: int, slot_bits: int):
        """head: the frequent words and their counts; rest: how many tokens are none of them."""
        # words that are spelled alike have codes that begin alike, where they are as frequent
        order = sorted(range(len(head)), key=head.__getitem__)
        self.head = [head[i] for i in order]
        self.counts = np.array([counts[i] for i in order], np.int64)
        self.rest = rest
        self.slot_bits = [slot_bits + (k >= PREDICTORS - 2) for k in range(PREDICTORS)]

    def __getattr__(self, name: str):
        """The codes and tables, worked out where they are first used: the driver needs none of them."""
        if name.startswith("_") or "rank" in self.__dict__:
            raise AttributeError(name)
        self.prepare()
        return self.__dict__[name]

    def prepare(self) -> None:
        self.rank = {w: i for i, w in enumerate(self.head)}
        self.word_lengths = code_lengths(np.append(self.counts, [max(1, self.rest), 1]))  # the escape, and one never used, so that no code is empty
        self.word_codes = canonical(self.word_lengths)
        pairs = np.ones((256, 256), np.int64)  # a byte after another, in words by the logarithm of their count
        text = np.frombuffer(b"".join(b" " + w + b" " for w in self.head), np.uint8)
        if len(text):
            sizes = np.array([len(w) + 2 for w in self.head])
            weight = np.repeat(1 + np.log2(self.counts + 1.0).astype(np.int64), sizes)
            inner = np.ones(len(text), bool)
            inner[np.cumsum(sizes) - sizes] = False
            at = np.flatnonzero(inner)
            pairs += np.bincount(text[at - 1].astype(np.int64) * 256 + text[at], weight[at], 65536).astype(np.int64).reshape(256, 256)
        lengths = [code_lengths(row) for row in pairs]
        self.byte_lengths = np.concatenate(lengths)
        self.byte_codes = np.concatenate([canonical(x) for x in lengths])
        self.hash = np.array([zlib.crc32(w) + 1 for w in self.head] + [0], np.uint64)
        self.tail = np.array([_tail(w) for w in self.head] + [0], np.uint64)

    def __getstate__(self):
        return (self.head, self.counts, self.rest, self.slot_bits)

    def __setstate__(self, state):
        self.head, self.counts, self.rest, self.slot_bits = state

    def _placed(self, codes: np.ndarray, lengths: np.ndarray, contexts: list[np.ndarray]) -> Runs:
        """The runs of symbols of such codes, and where their rows are; contexts: 32 bits for each symbol, of each predictor."""
        runs = Runs.of(codes, lengths)
        for k, c in enumerate(contexts):
            s = c.take(runs.symbol)
            s ^= runs.nodes
            s *= _SLOT
            s ^= s >> _V(15)
            s *= _NODE
            s >>= _V(32 - self.slot_bits[k])
            runs.rows.append(s.astype(np.int64))
        return runs

    def spelled(self, words: list[bytes], kinds: np.ndarray, before: np.ndarray, tails: np.ndarray):
        """(where each word's bits begin, runs) of the words' bytes and terminators; before: hash of the word before, tails: the bytes before."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1 + TAIL
        gap = b"\0" * TAIL
        data = np.frombuffer(gap + (b" " + gap).join(words) + b" ", np.uint8).copy()
        starts = np.cumsum(sizes) - sizes
        data[starts[:, None] + np.arange(TAIL)] = tails.astype("<u4").view(np.uint8).reshape(-1, TAIL)
        own = np.ones(len(data), bool)
        own[starts[:, None] + np.arange(TAIL)] = False
        at = np.flatnonzero(own)
        word = np.repeat(np.arange(len(words)), sizes - TAIL)
        last = data.astype(np.uint64)
        near = last[at - 1] + (last[at - 2] << _U(8))
        three = near + (last[at - 3] << _U(16))
        four = three + (last[at - 4] << _U(24))
        # the word so far: a sum of its bytes by rising powers, which is the same wherever it stands
        powers = np.cumprod(np.full(len(data), _POWER, np.uint64))
        sums = np.cumsum((last + _U(1)) * powers) - (last + _U(1)) * powers
        begin = (starts + TAIL)[word]
        inverse = np.cumprod(np.full(len(data), _INVERSE, np.uint64))
        so_far = (sums[at] - sums[begin]) * inverse[begin] + (at - begin).astype(np.uint64)
        hashes = [near, three * _ODD[3] + kinds[word].astype(np.uint64), four, so_far, so_far * _ODD[3] + before[word]]
        symbols = last[at - 1].astype(np.int64) * 256 + data[at]
        first = np.flatnonzero(at == begin)
        symbols[first] = 32 * 256 + data[at[first]].astype(np.int64)
        runs = self._placed(self.byte_codes[symbols], self.byte_lengths[symbols], [_mixed(h, 2 * k + 1) for k, h in enumerate(hashes)])
        return runs.begins[first], runs

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Of each word, which code it has, -1 for none."""
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words))

    def parts(self, words: list[bytes], of: np.ndarray, kinds: np.ndarray, first: np.ndarray, ids: np.ndarray | None = None, by_word: bool = False):
        """(tokens, where the bits of each begin, runs, phase), of word codes and of spellings; ``of`` says which word each token is, ``first`` marks tokens that begin a text.

        Tokens come in their order, or ``by_word`` and the bytes before, so that the same slots follow one another.
        """
        ids = self.ids(words) if ids is None else ids
        rare = np.flatnonzero(ids < 0)
        hashes, tails = self.hash[ids], self.tail[ids]
        spelt = [words[i] for i in rare.tolist()]
        hashes[rare] = np.fromiter(map(zlib.crc32, spelt), np.uint64, len(rare)) + _U(1)
        tails[rare] = np.fromiter(map(_tail, spelt), np.uint64, len(rare))
        hashes, tails = hashes.take(of), tails.take(of)
        tails, one = _later(tails, first), _later(hashes, first)
        two = one * _ODD[3] + _later(one, first)
        symbols = np.where(ids < 0, len(self.rank), ids).take(of)
        order = np.arange(len(of))
        if by_word:
            order = np.argsort(symbols.astype(np.uint64) << _U(32) | tails)
            of, kinds, symbols, tails, one, two = (x.take(order) for x in (of, kinds, symbols, tails, one, two))
        rare = np.flatnonzero(symbols == len(self.rank))
        spelt = [words[i] for i in of[rare].tolist()]
        kind = kinds.astype(np.uint64) + _U(1)
        for a in range(0, len(of), TOKENS):
            b = min(a + TOKENS, len(of))
            contexts = [np.zeros(b - a, np.uint64), kind[a:b], tails[a:b], one[a:b], two[a:b]]
            runs = self._placed(self.word_codes[symbols[a:b]], self.word_lengths[symbols[a:b]], [_mixed(c, 2 * k) for k, c in enumerate(contexts)])
            yield order[a:b], runs.begins, runs, 0
            last = int(np.searchsorted(rare, b))
            for i in range(int(np.searchsorted(rare, a)), last, SPELT):
                j = min(i + SPELT, last)
                block = rare[i:j]
                yield order[block], *self.spelled(spelt[i:j], kinds[block], one[block], tails[block]), 1


@dataclass
class Mixer:
    """Bit counts, gated weights and the adaptive map. The gate is how often the two longest contexts were seen."""

    counts: list[np.ndarray]  # of each predictor: slots x 2
    weights: np.ndarray  # (predictors + 1) x gates
    ones: np.ndarray  # gates * buckets
    total: np.ndarray

    @classmethod
    def of(cls, counts: list[np.ndarray]) -> Mixer:
        start = np.array([0.1, 0.1, 0.2, 0.3, 0.3, 0], np.float32)
        centre = 1 / (1 + np.exp(-(np.arange(_BUCKETS) - 16) / 2.0))
        return cls(counts, np.tile(start[:, None], (1, _GATES)), np.tile(centre * 2, _GATES), np.full(_GATES * _BUCKETS, 2.0))

    def frozen(self) -> Mixer:
        """For prediction only: without the counts."""
        out = Mixer([], self.weights, self.ones, self.total)
        out.__dict__.update(stretch=self.stretch, mapped=self.mapped)
        return out

    @cached_property
    def stretch(self) -> list[np.ndarray]:
        """Of each predictor, the logarithm of the odds in each slot; of the two longest contexts, the last two of its 32 bits are the slot's level."""
        out = []
        for k, n in enumerate(self.counts):
            x = np.log((n[:, 1] + np.float32(_PRIOR)) / (n[:, 0] + np.float32(_PRIOR)))
            if k >= PREDICTORS - 2:
                level = self._level(n[:, 0] + n[:, 1])
                x[(x == 0) & (level > 0)] = 1e-30  # a level alone would make a slow, subnormal number
                of = x.view(np.int32)
                of &= -_LEVELS
                of |= level
            out.append(x)
        return out

    @cached_property
    def mapped(self) -> np.ndarray:
        return (self.ones / self.total).astype(np.float32)

    @staticmethod
    def _level(seen: np.ndarray) -> np.ndarray:
        """0 for none, then up to 2, up to 11, more."""
        return (seen > 0).astype(np.int8) + (seen > 2) + (seen > 11)

    @staticmethod
    def _gate(shorter: np.ndarray, longer: np.ndarray, phase: int) -> np.ndarray:
        return longer * np.int8(_LEVELS) + (shorter + np.int8(_LEVELS * _LEVELS * phase))

    def mix(self, x: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """The predictors' odds, weighed; ``weights`` are those of each bit."""
        z = weights[PREDICTORS]
        for k in range(PREDICTORS):
            part = weights[k]
            part *= x[k]
            z += part
        return np.clip(z, -14, 14, out=z)

    @staticmethod
    def cell(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        near = np.rint(z * np.float32(2)).astype(np.int64)
        np.clip(near, -16, _BUCKETS - 17, out=near)
        near += 16
        near += gate * _BUCKETS
        return near

    def bit_logs(self, runs: Runs, phase: int) -> np.ndarray:
        """log2 of the probability of each bit: half mix, half map."""
        x = [s.take(runs.slots(k)) for k, s in enumerate(self.stretch)]
        gate = self._gate(*((v.view(np.int32) & (_LEVELS - 1)).astype(np.int8) for v in x[-2:]), phase).astype(np.int64)
        z = self.mix(x, [w.take(gate) for w in self.weights])
        mapped = self.mapped.take(self.cell(z, gate))
        p = np.float32(0.5) / (np.float32(1) + np.exp(-z)) + np.float32(0.5) * mapped
        np.clip(p, 1e-6, 1 - 1e-6, out=p)
        return np.log2(np.where(runs.bits, p, np.float32(1) - p))

    def learn(self, runs: Runs, phase: int, squares: np.ndarray, rate: float = 0.05) -> None:
        """Online: predict a block of bits from what came before, move the weights and the map by it, then count it."""
        prior, x, seen = np.float32(_PRIOR), [], []
        for k in range(PREDICTORS):
            flat, at = self.counts[k].reshape(-1), runs.slots(k)
            n = flat.view(np.complex64).take(at)
            at <<= 1
            at |= runs.bits
            np.add.at(flat, at, np.float32(1))  # while its rows are near; n is from before
            if k >= PREDICTORS - 2:
                seen.append(self._level(n.real + n.imag))
            ratio = n.imag + prior
            ratio /= n.real + prior
            x.append(np.log(ratio, out=ratio))
        gate = self._gate(*seen, phase)
        # bits gate by gate, so that what a gate has in common is repeated and its sums are of neighbours
        order, sizes = np.argsort(gate, kind="stable"), np.bincount(gate, minlength=_GATES)
        x, bits = [v.take(order) for v in x], runs.bits.take(order)
        z = self.mix(x, [np.repeat(w, sizes) for w in self.weights])
        cell = self.cell(z, np.repeat(np.arange(_GATES), sizes))
        cell <<= 1
        cell |= bits
        of_cell = np.bincount(cell, minlength=2 * len(self.ones)).reshape(-1, 2)
        self.ones += of_cell[:, 1]
        self.total += of_cell.sum(axis=1)
        error = bits.astype(np.float32)
        error -= np.float32(1) / (np.float32(1) + np.exp(-z))
        met = np.flatnonzero(sizes)
        begins = (np.cumsum(sizes) - sizes)[met]
        step = np.zeros(squares.shape)
        for k in range(PREDICTORS):
            step[k, met] = np.add.reduceat(np.multiply(x[k], error, out=x[k]), begins)
        step[PREDICTORS, met] = np.add.reduceat(error, begins)
        step[:, met] /= sizes[met]
        squares += step * step
        self.weights += (rate * step / np.sqrt(squares + 1e-8)).astype(np.float32)

    def token_logs(self, coder: Coder, words: list[bytes], kinds: np.ndarray, first: np.ndarray | None = None, of: np.ndarray | None = None, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log2 of the probability of each token's code after the tokens before it, and of its spelling, 0 where it has none; without ``first`` each is a text's first, without ``of`` each word is one token."""
        of = np.arange(len(words)) if of is None else of
        codes, spellings = np.zeros(len(of)), np.zeros(len(of))
        for which, begins, runs, phase in coder.parts(words, of, kinds, np.ones(len(of), bool) if first is None else first, ids, by_word=True):
            (spellings if phase else codes)[which] = np.add.reduceat(self.bit_logs(runs, phase), begins, dtype=np.float64)
        return codes, spellings


def tokens_in(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(tokens, tokens of each text) of texts, each with its end: what lower() and split() do, for all texts at once."""
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kept = ~_SPACE[data]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    kept[ends] = begins[ends] = True  # a word before an end has ended there, one after it is new
    after = ends[:-1] + 1
    begins[after] = kept[after]
    before = np.cumsum(kept, dtype=np.int32)
    at = np.flatnonzero(begins)
    offsets = np.append(before[at] - 1, before[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    return words, np.diff(np.searchsorted(at, ends, "right"), prepend=0)


def tokens_of(texts: list[bytes]) -> tuple[pa.Array, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, the same as a list, which of them each token is, kinds of the tokens, tokens of each text) of texts, each with its end.

    A token's kind is that of the last word above ASCII before it in its text, 0 before any.
    """
    tokens, sizes = tokens_in(texts)
    encoded = tokens.dictionary_encode()
    distinct, of = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
    words = distinct.to_numpy(zero_copy_only=False).tolist()
    _, offsets, data = distinct.buffers()
    offsets = np.frombuffer(offsets, np.int32)[distinct.offset :][: len(words)]
    shown = np.maximum.reduceat(np.frombuffer(data, np.uint8), offsets)
    shown = np.fromiter((kind_of(w) if b > 127 else 0 for w, b in zip(words, shown.tolist(), strict=True)), np.int64, len(words)).take(of)
    last = np.where(shown > 0, np.arange(len(of)), -1)
    last[1:], last[0] = np.maximum.accumulate(last[:-1]), -1
    own = last >= np.repeat(np.cumsum(sizes) - sizes, sizes)
    return distinct, words, of, np.where(own, shown.take(last), 0), sizes


def blocks_of(texts: list[bytes]):
    """Texts in groups of about BLOCK_BYTES."""
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held > BLOCK_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def firsts(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(int(sizes.sum()), bool)
    out[np.cumsum(sizes) - sizes] = True
    return out


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, c): how often each token occurs."""

    def counted(held):
        found = pa.chunked_array(held, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for group in blocks_of(as_bytes(batch.column(0))):
                words, _ = tokens_in(group)
                held.append(words)
                size += words.nbytes
                if size > COUNTED_BYTES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return df.select(text_of(text).alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    counts: DataFrame  # word, c: all training tokens
    train_tokens: int
    distinct: int
    coder: Coder
    mixer: Mixer
    single: float  # share of the spelled training words that occur once


def frequent(counts: DataFrame, tokens: int) -> list[tuple[bytes, int]]:
    """The words that have a code of their own and their counts: all from a count on that leaves no more than the limit, which follows the tokens up to HEAD."""
    most = max(1 << 15, min(HEAD, tokens // TOKENS_A_WORD))
    last = 1 << 14
    sizes = counts.filter(F.col("c") >= HEAD_LEAST).groupBy(F.least("c", F.lit(last)).alias("c")).count().orderBy(F.desc("c")).collect()  # a row for each count up to ``last``
    least, held = None, 0
    for c, n in sizes:
        if held + n > most and least is not None:
            break
        least, held = c, held + n
    if least is None:
        return []
    rows = counts.filter(F.col("c") >= least).select("word", "c")
    rows = rows.orderBy(F.desc("c"), "word").limit(most) if held > most else rows  # more than the limit occur ``last`` times or more
    found = rows.toArrow()
    return list(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True))


def learn(df: DataFrame, text: str = "text") -> Model:
    """A model of all texts of df. Without any text it knows nothing: N and V are 0 and every bit has its prior."""
    spark = df.sparkSession
    counts = stored(word_counts(df, text))
    tokens, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("c") == 1).cast("bigint")), F.lit(0))).first()
    top = frequent(counts, int(tokens))
    known = [c for _, c in top]
    slot_bits = min(max(LEAST_SLOT_BITS, int(tokens).bit_length()), SLOT_BITS)
    coder = Coder([w for w, _ in top], known, int(tokens) - sum(known), slot_bits)
    shared = spark.sparkContext.broadcast(coder)
    sizes = [1 << b for b in coder.slot_bits]
    total = 2 * sum(sizes)
    size = total // CHUNKS

    def tables(flat: np.ndarray) -> list[np.ndarray]:
        return [x.reshape(-1, 2) for x in np.split(flat, np.cumsum([2 * n for n in sizes])[:-1])]

    def online(batches):
        flat = np.zeros(total, np.float32)
        c, m = shared.value, Mixer.of(tables(flat))
        m.ones, m.total = np.zeros_like(m.ones), np.zeros_like(m.total)
        squares = np.zeros_like(m.weights)
        for batch in batches:
            for group in blocks_of(as_bytes(batch.column(0))):
                _, words, of, kinds, lengths = tokens_of(group)
                for _, _, runs, phase in c.parts(words, of, kinds, firsts(lengths)):
                    m.learn(runs, phase, squares)
        seen = m.total.reshape(_GATES, _BUCKETS).sum(axis=1)
        if seen.any():
            row = [m.weights.astype(np.float64) * seen, seen, m.ones, m.total]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([-1], pa.int32()), "n": pa.array([np.concatenate([a.ravel() for a in row]).tobytes()], pa.binary())})
        for k in range(CHUNKS):
            part = flat[k * size : (k + 1) * size]
            if part.any():
                small = part.max() < 1 << 16
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "n": pa.array([(part.astype(np.uint16) if small else part.astype(np.float64)).tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(n, np.uint16 if len(n) == 2 * size and k >= 0 else np.float64).astype(np.float64)
        for k, n in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "n": pa.array([(n if k < 0 else n.astype(np.float32)).tobytes()], pa.binary())})

    kind = "chunk int, n binary"
    found = np.zeros(total, np.float32)
    mixer = Mixer.of(tables(found))
    tasks = max(spark.sparkContext.defaultParallelism, int(tokens) // TASK_TOKENS)
    rows = stored(df.select(text_of(text).alias("text")).coalesce(tasks).mapInArrow(online, kind).repartition(CHUNKS, "chunk").mapInArrow(add, kind))
    for r in rows.toLocalIterator():  # the tables, of bounded size, a part at a time
        if r["chunk"] >= 0:
            found[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["n"], np.float32)
            continue
        w, seen, ones, totals = np.split(np.frombuffer(r["n"]), np.cumsum([mixer.weights.size, _GATES, mixer.ones.size]))
        mixer.ones, mixer.total = mixer.ones + ones, mixer.total + totals
        mixer.weights = np.where(seen > 0, w.reshape(mixer.weights.shape) / np.maximum(seen, 1e-9), mixer.weights).astype(np.float32)
    return Model(counts, int(tokens), int(distinct), coder, mixer, min(0.95, max(0.05, once / max(1, coder.rest))))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all but the text, if None) with n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte.

    A null text counts as empty: its only token is the end. ``score`` is the model's
    log10 probability of the tokens, ``base_score`` that of the add-one word counts;
    bits_per_byte is null where there is no byte. Each text is scored whole and by itself, however
    long, so repeated rows have equal scores; an empty table gives no rows. Input
    columns named like a result are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != text and c.lower() not in RESULTS]
    shared = df.sparkSession.sparkContext.broadcast((model.coder, model.mixer.frozen()))

    def start():
        coder, mixer = shared.value
        gains = np.log10(coder.counts + 1.0)

        def block(texts: list[bytes]) -> list:
            distinct, words, of, kinds, sizes = tokens_of(texts)
            codes_of = coder.ids(words)
            ids = codes_of.take(of)
            begins = np.cumsum(sizes) - sizes
            head = ids >= 0
            known = np.add.reduceat(head, begins, dtype=np.int64)
            base = np.add.reduceat(np.append(gains, 0.0)[ids], begins)
            codes, spellings = mixer.token_logs(coder, words, kinds, firsts(sizes), of, codes_of)
            at = np.flatnonzero(~head)
            ends = np.concatenate([[0], np.cumsum(sizes - known)])
            pairs = pa.StructArray.from_arrays([distinct.take(pa.array(of[at])), pa.array(spellings[at])], ["word", "spelled"])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            out = [pa.array(x, pa.int64()) for x in (sizes, known)] + [pa.array(x) for x in (base, np.add.reduceat(codes, begins))]
            return [*out, pa.array([len(t) for t in texts], pa.int64()), rare]

        def run(texts: pa.Array):
            done = [block(group) for group in blocks_of(as_bytes(texts))]
            return [pa.concat_arrays(x) for x in zip(*done, strict=True)]

        return run

    fields = "n_tokens bigint, known bigint, base double, codes double, n_bytes bigint, rare array<struct<word: binary, spelled: double>>"
    rows = stored(map_batches(df, keep, [text_of(text)], fields, start).withColumn("__row", F.monotonically_increasing_id()))
    rare = rows.select("__row", F.explode("rare").alias("r")).select("__row", "r.*")
    # a spelled word's probability, in base 2: of its spelling and of its share of the spelled training words
    listed = F.log2(F.col("c") / F.lit(float(max(1, model.coder.rest)))) + math.log2(1 - model.single)
    own = F.col("spelled") + math.log2(model.single)
    high, low = F.greatest(own, listed), F.least(own, listed)
    spelled = F.when(F.col("c").isNull(), own).otherwise(high + F.log2(1 + F.pow(F.lit(2.0), low - high)))
    found = rare.join(model.counts, "word", "left").groupBy(F.col("__row").alias("__of")).agg(F.count("c").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("gain"), F.sum(spelled).alias("spelled"))
    n = model.train_tokens
    joined = rows.join(found, F.col("__row") == F.col("__of"), "left")
    logs = F.col("codes") + F.coalesce("spelled", F.lit(0.0))
    return joined.select(
        *[F.col(f"`{c}`") for c in keep],
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + model.distinct + 1))).alias("base_score"),
        (logs * math.log10(2)).alias("score"),
        "n_bytes",
        (-logs / F.nullif(F.col("n_bytes"), F.lit(0))).alias("bits_per_byte"),
    )


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    model = learn(documents.filter(~held_out))
    return score(documents, model, keep=["doc_id"]).withColumn("held_out", held_out)
