"""Text quality by Bradley-Terry ranking.

Every text has a merit, linear in its features; of a pair, the better text is preferred with the
logistic of the merits' difference. Weights minimize the logistic loss over all preference pairs: each
labelled text of label 1 over each of label 0. The threshold is the quantile of all their merits that
leaves as large a share above as label 1 has; the score maps it to 0.7 and rises with merit.

Features of all rows are made once and saved, those of the labelled rows once more. L-BFGS reads the
latter twice a step and has partial sums come to the driver. First the merits of either label are
counted on a grid, a merit dealt to the two points beside it, and one convolution gives the loss over
all pairs and, at each point, how strongly the other label's texts pull a text there. Then every row
adds its pull to the gradient. The grid makes the loss wrong by 1e-6 at most. The threshold is found
exactly by counts in ever narrower ranges.

Features: shares of kinds of characters, lengths, repetition of words and lines, and the shares of
word shapes (runs of letters, digits and signs), hashed.

Defined results: null and empty texts have features like any other (all shares zero); without labels
of both kinds every score is 0.5; repeated rows have equal scores; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, slices, small_batches, tidy
from .labelled import TEXT_BYTES, THRESHOLD, split

SHAPES = 512
PAIRS, PASSES, BATCH, RATE, DECAY = 40_000, 6, 256, 0.05, 1e-4
#: Letters of any script become a or A, digits 0, white space a space; signs stay.
KINDS = bytes(ord("a") if chr(c).islower() or c >= 128 else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else 32 if chr(c).isspace() else c for c in range(256))
STATISTICS = 18
#: A feature that isn't zero.
CELL = np.dtype([("at", "<u2"), ("value", "<f4")])
#: Rows whose features are handled at once.
ROWS = 8_192
#: Between points of the grid of merits; ranges that one count of merits tells apart.
STEP, RANGES = 1 / 256, 4_096
#: Steps of L-BFGS at most, those it remembers, and the share of the loss a step must save for another.
STEPS, MEMORY, LEAST = 60, 12, 1e-4


def features(text: bytes) -> np.ndarray:
    kinds = text.translate(KINDS)
    n = max(1, len(kinds))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    counts, line_counts = Counter(words), Counter(lines)
    m, k = max(1, len(words)), max(1, len(lines))
    lower, upper, digit, space = (kinds.count(c) / n for c in (b"a", b"A", b"0", b" "))
    signs = 1 - lower - upper - digit - space
    usual = sum(text.count(c) for c in (b".", b",", b"'", b"-", b"?", b"!")) / n
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    out = np.zeros(STATISTICS + SHAPES, np.float32)
    out[:STATISTICS] = (
        math.log1p(n), lower, upper, digit, space, signs, usual, signs - usual, math.log1p(m), lengths.mean(), lengths.std(), len(counts) / m,
        max(counts.values(), default=0) / m, math.log1p(k), len(line_counts) / k, max(line_counts.values(), default=0) / k, math.log1p(m / k), len(words) < 5,
    )
    codes = np.frombuffer(kinds, np.uint8)
    if len(codes):
        shape = codes[np.concatenate([[True], codes[1:] != codes[:-1]])].tobytes()
        for s, c in Counter(shape.split()).items():
            out[STATISTICS + zlib.crc32(s) % SHAPES] += c / m
    return out


def cells(text: bytes) -> bytes:
    x = features(text)
    out = np.empty(np.count_nonzero(x), CELL)
    out["at"] = np.flatnonzero(x)
    out["value"] = x[out["at"]]
    return out.tobytes()


def opened(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each cell."""
    found = np.frombuffer(b"".join(packed), CELL)
    row = np.repeat(np.arange(len(packed)), [len(x) // CELL.itemsize for x in packed])
    return row, found["at"].astype(np.int64), found["value"].astype(np.float64)


def standard(at: np.ndarray, value: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The standardized features of a text without cells, and what each cell adds to its own."""
    zero = np.clip(-mean / scale, -8, 8)
    return zero, np.clip((value - mean[at]) / scale[at], -8, 8) - zero[at]


def merits(packed: list[bytes], w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    row, at, value = opened(packed)
    zero, more = standard(at, value, mean, scale)
    return zero @ w + np.bincount(row, more * w[at], len(packed))


# ---- all pairs ------------------------------------------------------------------------------------

#: Runs over all labelled rows: the first function makes something of labels and cells, the second merges two of these.
Run = Callable[[Callable, Callable], object]


def moments(y: np.ndarray, packed: list[bytes], size: int = STATISTICS + SHAPES) -> tuple:
    """Rows, rows of label 1, means of the features and sums of their squared distances from these."""
    _, at, value = opened(packed)
    n = len(y)
    mean = np.bincount(at, value, size) / n
    return n, int(y.sum()), mean, np.bincount(at, (value - mean[at]) ** 2, size) + (n - np.bincount(at, minlength=size)) * mean**2


def both_moments(a: tuple, b: tuple) -> tuple:
    n, d = a[0] + b[0], b[2] - a[2]
    return n, a[1] + b[1], a[2] + d * (b[0] / n), a[3] + b[3] + d * d * (a[0] * b[0] / n)


def tally(bins: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins in order and the sums of their rows of mass."""
    once, place = np.unique(bins, return_inverse=True)
    return once, np.stack([np.bincount(place, column, len(once)) for column in mass.T], 1)


def both_tallies(a: tuple, b: tuple) -> tuple:
    return tally(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


def on_grid(y: np.ndarray, merit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merits of label 0 and 1, each dealt to the two points beside it."""
    point = np.floor(merit / STEP).astype(np.int64)
    over = merit / STEP - point
    mass = np.concatenate([1 - over, over])[:, None]
    return tally(np.concatenate([point, point + 1]), mass * (np.concatenate([y, y])[:, None] == [0, 1]))


def preferences(points: np.ndarray, mass: np.ndarray) -> tuple[float, int, np.ndarray]:
    """The mean loss over all pairs, the first point, and from there on by how much the mean loss of a
    text of label 0 rises, and that of a text of label 1 falls, with its merit."""
    first, n = int(points[0]), int(points[-1] - points[0]) + 1
    share = np.zeros((2, n))
    share[:, points - first] = (mass / mass.sum(0)).T
    d = STEP * np.arange(1 - n, n)
    lost = 1 / (1 + np.exp(np.clip(d, -500, 500)))
    size = 1 << (3 * n).bit_length()

    def against(other: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(other, size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]

    loss = float(share[1] @ against(share[0], np.logaddexp(0, -d)))
    return loss, first, np.stack([against(share[1], lost[::-1]), against(share[0], lost)])


def pull(y: np.ndarray, packed: list[bytes], w: np.ndarray, mean: np.ndarray, scale: np.ndarray, counts: np.ndarray, first: int, slopes: np.ndarray) -> np.ndarray:
    """What rows add to the gradient of the mean loss. counts: rows of label 0 and of label 1."""
    row, at, value = opened(packed)
    zero, more = standard(at, value, mean, scale)
    place = (zero @ w + np.bincount(row, more * w[at], len(packed))) / STEP - first
    point = np.clip(np.floor(place).astype(np.int64), 0, slopes.shape[1] - 2)
    over = place - point
    c = (slopes[y, point] * (1 - over) + slopes[y, point + 1] * over) * np.where(y == 1, -1, 1) / counts[y]
    return zero * c.sum() + np.bincount(at, c[row] * more, len(w))


def direction(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """L-BFGS: the gradient times the inverse curvature that past changes of weights and gradient show."""
    q, factors = g.copy(), []
    for s, t in reversed(past):
        factors.append(s @ q / (s @ t))
        q -= factors[-1] * t
    if past:
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
    else:
        q /= max(1.0, np.sqrt(g @ g))
    for (s, t), a in zip(past, reversed(factors), strict=True):
        q += (a - t @ q / (s @ t)) * s
    return -q


def cut_of(run: Run, least_above: int, merit: Callable[[list[bytes]], np.ndarray]) -> float:
    """Between the highest merit that at least so many rows reach and the next lower one:
    where numpy's quantile is if they are neighbours in rank."""

    def both(a: tuple, b: tuple) -> tuple:
        once, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        count = np.bincount(place, np.concatenate([a[1], b[1]]), len(once))
        low, high = np.full(len(once), np.inf), np.full(len(once), -np.inf)
        np.minimum.at(low, place, np.concatenate([a[2], b[2]]))
        np.maximum.at(high, place, np.concatenate([a[3], b[3]]))
        return once, count, low, high

    def ranges(low: float, high: float):
        def make(y: np.ndarray, packed: list[bytes]) -> tuple:
            m = merit(packed)
            # 0 is all below, RANGES + 1 all above
            at = np.where(m < low, 0, np.where(m > high, RANGES + 1, 1 + np.minimum((np.clip(m, low, high) - low) / (high - low) * RANGES, RANGES - 1))).astype(np.int64)
            return both((at, np.ones(len(m)), m, m), (at[:0], m[:0], m[:0], m[:0]))

        return make

    low, high = -1e300, 1e300
    while True:
        at, count, lows, highs = run(ranges(low, high), both)
        above = np.cumsum(count[::-1])[::-1]
        k = int(np.flatnonzero(above >= least_above)[-1])
        if lows[k] == highs[k]:
            break
        low, high = float(lows[k]), float(highs[k])
    rows = int(count.sum())
    under = float(highs[k - 1]) if k else float(lows[k]) - 1
    return under + (float(lows[k]) - under) * least_above / rows


def fit(run: Run) -> np.ndarray | None:
    """Weights, intercept, means and scales from all pairs of the rows that run goes over; none without
    rows of both labels."""
    found = run(moments, both_moments)
    if found is None or not 0 < found[1] < found[0]:
        return None
    n, good, mean, squares = found
    scale = np.sqrt(squares / n)
    scale = np.where(scale > 1e-6, scale, np.inf)
    counts = np.array([n - good, good], np.float64)

    def look(w: np.ndarray) -> tuple[float, int, np.ndarray]:
        loss, first, slopes = preferences(*run(lambda y, packed: on_grid(y, merits(packed, w, mean, scale)), both_tallies))
        return loss + DECAY / 2 * (w @ w), first, slopes

    def gradient(w: np.ndarray, first: int, slopes: np.ndarray) -> np.ndarray:
        return run(lambda y, packed: pull(y, packed, w, mean, scale, counts, first, slopes), np.add) + DECAY * w

    w, past = np.zeros(len(mean)), []
    loss, *at = look(w)
    g = gradient(w, *at)
    for _ in range(STEPS):
        d = direction(g, past)
        for k in range(12):
            new = w + d / 2**k
            less, *at = look(new)
            if less <= loss + 1e-4 / 2**k * (g @ d):
                break
        else:
            break
        last, g = g, gradient(new, *at)
        if (new - w) @ (g - last) > 0:
            past = [*past, (new - w, g - last)][-MEMORY:]
        done = loss - less < LEAST * less
        w, loss = new, less
        if done:
            break
    cut = cut_of(run, good, lambda packed: merits(packed, w, mean, scale))
    return np.concatenate([w, [-cut], mean, scale])


# ---- tables ---------------------------------------------------------------------------------------


def vectors(documents: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, a hash of the text and its features for every row, saved."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, 128, TEXT_BYTES):
                packed = pa.array([cells(t or b"") for t in batch.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["doc_id", "held_out", "digest", "cells"])
        tidy()

    small_batches(documents.sparkSession)
    text = F.col("text").cast("binary")
    rows = documents.select("doc_id", held_out.alias("held_out"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return save(rows.mapInArrow(made, "doc_id long, held_out boolean, digest long, cells binary"), "features")


def over(rows: DataFrame) -> Run:
    """Runs over rows of label and cells; only what is made of a partition comes to the driver."""

    def run(make: Callable, merge: Callable) -> object:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    new = make(batch.column(0).to_numpy(), batch.column(1).to_pylist())
                    found = new if found is None else merge(found, new)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["found"])
            tidy()

        parts = [pickle.loads(p) for p in rows.mapInArrow(partial, "found binary").toArrow()["found"].to_pylist()]
        return functools.reduce(merge, parts) if parts else None

    return run


def learnt(made: DataFrame, labels: DataFrame, learn_from: Column) -> np.ndarray | None:
    """Weights from all rows of made that labels mark; a text that repeats with its id and label counts once."""
    label = F.col("quality")
    marks = labels.where(learn_from & label.isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).distinct()
    rows = made.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", "cells").join(marks, "doc_id")
    # dealt by all three, so that adaptive execution may split an id that very many texts share in the join
    rows = rows.repartition("doc_id", "label", "digest").groupBy("doc_id", "label", "digest").agg(F.first("cells").alias("cells"))
    # in order, so that sums and with them weights come out the same again
    return fit(over(save(rows.sortWithinPartitions("doc_id", "label", "digest").select("label", "cells"), "learning")))


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 1) -> tuple[np.ndarray, float]:
    """For arrays in memory, by AdaGrad on drawn pairs; the tables' model doesn't use it. Weights and
    intercept of the merit; merit >= 0 is the quantile that label 1's share leaves above."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, np.inf)
    s = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, squares = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    for _ in range(PASSES):
        for at in np.array_split(rng.permutation(pairs), max(1, pairs // BATCH)):
            d = s[a[at]] - s[b[at]]
            g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -35, 35))))[:, None]).mean(0) + DECAY * w
            squares += g * g
            w -= RATE * g / np.sqrt(squares)
    merit = s @ w
    cut = float(np.quantile(merit, 1 - y.mean()))
    return np.concatenate([w, [-cut], mean, scale]), 1.0


def scorer(packed: np.ndarray | None, threshold: float = THRESHOLD):
    """A function from packed features to scores; 0.5 for all without a model."""
    n = STATISTICS + SHAPES
    at = math.log(threshold / (1 - threshold))

    def score(rows: list[bytes]) -> np.ndarray:
        if packed is None:
            return np.full(len(rows), 0.5)
        merit = merits(rows, packed[:n], packed[n + 1 : 2 * n + 1], packed[2 * n + 1 :]) + packed[n]
        return 1 / (1 + np.exp(-np.clip(merit + at, -35, 35)))

    return score


def model(documents: DataFrame, labels: DataFrame, learn_from: Column | None = None):
    """A function from texts to scores, learnt from all labelled rows that learn_from allows."""
    score = scorer(learnt(vectors(documents, F.lit(False)), labels, F.lit(True) if learn_from is None else learn_from))
    return lambda texts: score([cells(t) for t in texts])


def quality(documents: DataFrame, corpus: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of documents by a model learnt from corpus's labelled rows that aren't held out."""
    out = split(parts, held)
    made = vectors(corpus, out)
    score = scorer(learnt(made, labels, ~out))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score(batch.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])
        tidy()

    rows = made if documents is corpus else vectors(documents, out)
    rows = rows.select("doc_id", "held_out", "cells").mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
