"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.llm.common import as_bytes, lowered_words, map_batches, remainder, stored, table, text_of, without

#: Slots for hashed words; the slots after them are for structure and metadata.
WORD_SLOTS = 1 << 16
_BINS = 12
_STATS = ("length", "words", "capitals", "digits", "marks", "above ascii", "word length", "distinct words", "repeated lines", "line length", "short words", "mark runs", "given length", "ends")
SLOTS = WORD_SLOTS + len(_STATS) * _BINS
RESULTS = ("score", "predicted")
#: Labelled rows to learn from at most, taken by hash of the key.
TRAINING_ROWS = 8000
#: Bytes of training rows on the driver at a time.
PART_BYTES = 1 << 26
THRESHOLD = 0.3
_CAPITALS, _DIGITS, _LETTERS = (bytes(range(a, b)) for a, b in ((65, 91), (48, 58), (97, 123)))
_MARKS = bytes(set(range(33, 127)) - set(_CAPITALS + _DIGITS + _LETTERS))
_ABOVE = bytes(range(128, 256))
_RUN = re.compile(rb"([^\w\s])\1{2,}")


def _bin(x: float, scale: float) -> int:
    """0 for nothing, then one bin for each factor of two below the scale."""
    return 0 if x <= 0 else max(1, min(_BINS - 1, _BINS - 1 + int(np.floor(np.log2(x / scale)))))


def row_features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text: words by tf, normalised to length 1; a slot for the bin of each statistic."""
    words = lowered_words(text)
    n, size = len(words), max(1, len(text))
    counts = Counter(words)
    lines = text.split(b"\n")
    share = lambda kinds: 1 - len(text.translate(None, kinds)) / size
    stats = (
        _bin(len(text), 1 << 16), _bin(n, 1 << 13), _bin(share(_CAPITALS), 1), _bin(share(_DIGITS), 1), _bin(share(_MARKS), 1), _bin(share(_ABOVE), 1),
        _bin(len(text) / max(1, n), 64), min(_BINS - 1, int(_BINS * len(counts) / max(1, n))), min(_BINS - 1, int(_BINS * (1 - len(set(lines)) / len(lines)))),
        _bin(len(text) / len(lines), 4096), min(_BINS - 1, int(_BINS * sum(len(w) < 4 for w in words) / max(1, n))), _bin(len(_RUN.findall(text)) / max(1, n), 1),
        _bin(n_chars or 0, 1 << 16), _bin(sum(w[-1:] in b".!?" for w in words) / max(1, n), 1),
    )
    slots = np.fromiter((zlib.crc32(w) % WORD_SLOTS for w in counts), np.int32, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(values):
        values /= np.sqrt((values * values).sum())
    own = WORD_SLOTS + np.arange(len(stats), dtype=np.int32) * _BINS + np.array(stats, np.int32)
    return np.concatenate([slots, own]), np.concatenate([values, np.full(len(stats), 0.5, np.float32)]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of rows that begin at ``starts`` and are never empty. The pairs of a row, in linear time:
        sum over i<j of <v_i, v_j> x_i x_j is half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2."""
        vx = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weights[slots] * values, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)


Row = tuple[np.ndarray, np.ndarray, int]


def fit(parts: list[Callable[[], list[Row]]], share: float, rank: int = 6, epochs: int = 6, rate: float = 0.1, decay: float = 2e-5, batch: int = 64, seed: int = 7) -> Machine:
    """By AdaGrad on the logistic loss, from parts of rows (slots, values, label), of which one is held at a time.

    share: the rows of label 1. With one label only, or none, the machine gives its share.
    """
    rng = np.random.default_rng(seed)
    alone = share in (0, 1) or not parts
    share = float(np.clip(share, 0.02, 0.98))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SLOTS, np.float32), np.zeros((SLOTS, rank), np.float32))
    if alone:
        return m
    m.factors = rng.normal(0, 0.05, (SLOTS, rank)).astype(np.float32)
    gw, gv = np.full(SLOTS, 1e-4, np.float32), np.full((SLOTS, rank), 1e-4, np.float32)
    for part in [parts[i] for _ in range(epochs) for i in rng.permutation(len(parts))]:
        rows = part()
        y = np.array([r[2] for r in rows], np.float32)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            slots, values = (np.concatenate([rows[i][k] for i in ids]) for k in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in ids])
            starts = np.cumsum(sizes) - sizes
            error = 1 / (1 + np.exp(-m.margins(slots, values, starts))) - y[ids]
            m.bias -= 0.05 * float(error.mean())
            vx = m.factors[slots] * values[:, None]
            of_row = np.repeat(np.add.reduceat(vx, starts, axis=0), sizes, axis=0)
            ex = np.repeat(error, sizes) * values
            used, where = np.unique(slots, return_inverse=True)
            dw = np.bincount(where, ex, len(used)) / len(ids) + decay * m.weights[used]
            pairs = ex[:, None] * (of_row - vx)
            dv = np.stack([np.bincount(where, pairs[:, f], len(used)) for f in range(rank)], axis=1) / len(ids) + decay * m.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= rate * dv / np.sqrt(gv[used])
    return m


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = TRAINING_ROWS, length: Column | None = None) -> Machine:
    """A machine from the labelled rows whose key has no remainder 0 (crc32 modulo 5).

    At most ``most`` rows are learned from, those whose keys have the smallest
    hashes; they are described on the executors and learned from in parts of about
    PART_BYTES, one at a time, however long their texts. Rows without a key or a label of 0
    or 1 are no examples; a key's labels count as the greater.
    """
    usable = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).filter("__k is not null and __y in (0, 1)")
    usable = usable.filter(remainder("__k", 5) != 0).withColumn("__h", F.xxhash64("__k"))
    # no partition sends much more than its part of twice ``most`` rows to where they are ordered
    count = usable.count()
    low = usable.filter(F.col("__h") < int((2 * 2 * most / max(1, count) - 1) * (1 << 63))) if count > 2 * most else usable
    if count > 2 * most and low.select("__k").distinct().count() < most:
        low = usable
    chosen = low.groupBy("__k", "__h").agg(F.max("__y").alias("__y")).orderBy("__h", "__k").limit(most).select("__k", "__y")
    found = df.join(F.broadcast(chosen), F.col(f"`{key}`") == F.col("__k"))  # `most` rows

    def start():
        def run(texts: pa.Array, lengths: pa.Array, ys: pa.Array):
            rows = [row_features(t, n) for t, n in zip(as_bytes(texts), lengths.to_pylist(), strict=True)]
            return [ys, [r[0].tobytes() for r in rows], [r[1].tobytes() for r in rows]]

        return run

    inputs = [text_of(text), F.length(text_of(text)) if length is None else length, F.col("__y")]
    rows = stored(map_batches(found, ["__k"], inputs, "y int, slots binary, x binary", start).withColumn("h", F.xxhash64("__k", "slots")))
    n, share, size = rows.agg(F.count("*"), F.avg("y"), F.sum(F.octet_length("slots") + F.octet_length("x"))).first()
    parts = 1 + (size or 0) // PART_BYTES

    def part(i: int) -> list[Row]:
        here = rows.filter(F.pmod("h", F.lit(parts)) == i).orderBy("__k", "h").collect()
        return [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["x"], np.float32), r["y"]) for r in here]

    held = part(0) if parts == 1 and n else []
    return fit([lambda i=i: held or part(i) for i in range(parts if n else 0)], share if n else 0.5)


def score(df: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, length: Column | None = None) -> DataFrame:
    """The columns ``keep`` of df (all, if None) with score, from 0 to 1, and predicted, 1 where score >= threshold.

    Null texts count as empty; an empty text has only its structure. Texts are taken
    whole, each by itself, so repeated rows have equal scores. An empty table gives no rows.
    Input columns named like a result are replaced.
    """
    df = without(df, *RESULTS)
    model = df.sparkSession.sparkContext.broadcast(machine)

    def start():
        m = model.value

        def run(texts: pa.Array, lengths: pa.Array):
            out: list[float] = []
            rows: list[tuple[np.ndarray, np.ndarray]] = []

            def done() -> None:
                if rows:
                    sizes = np.array([len(r[0]) for r in rows])
                    z = m.margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes)
                    out.extend((1 / (1 + np.exp(-z.astype(np.float64)))).tolist())
                    rows.clear()

            held = 0
            for t, n in zip(as_bytes(texts), lengths.to_pylist(), strict=True):
                rows.append(row_features(t, n))
                held += len(rows[-1][0])
                if held > 100_000:
                    done()
                    held = 0
            done()
            return out, [int(s >= threshold) for s in out]

        return run

    inputs = [text_of(text), F.length(text_of(text)) if length is None else length]
    return map_batches(df, df.columns if keep is None else keep, inputs, "score double, predicted int", start)


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from the labels of those that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = train(documents, table(spark, sf_dir, "labels"), length=F.col("n_chars"))
    scored = score(documents, machine, keep=["doc_id"], length=F.col("n_chars"))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
