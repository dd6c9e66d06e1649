"""Toxicity by FTRL-proximal logistic regression.

Features are the presence of hashed words, word bigrams and skip-grams over one word. Each coordinate
has its own learning rate and the L1 penalty leaves most weights at zero, so the model is a short list
of cells and weights that goes with the tasks. Follow-the-regularized-leader with per-coordinate
rates, as published by McMahan and others.

Defined results: null and empty texts have no features and get the score of the intercept; without
labels of both kinds every score is the prior, 0.5; repeated rows have equal scores; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .labelled import BOUND, THRESHOLD, sample_features, sample_labels, score_texts, split

CELLS = 1 << 20
#: Words whose hashes are kept, and the longest of them.
KNOWN_WORDS, KNOWN_CHARS = 60_000, 64
WORDS = re.compile(r"\w+")
ALPHA, BETA, L1, L2, PASSES = 5.0, 1.0, 6.0, 0.0, 6
#: Cells of fewer sampled texts than this are left out.
LEAST_TEXTS = 3
#: Cells of a text that it is learnt by; scores look at all.
MOST_CELLS = 4_096


class Grams:
    """Cells of a text's words, bigrams and skip-grams, with repeats."""

    def __init__(self, cells: int = CELLS):
        self.mask, self.known = np.uint32(cells - 1), {}

    def __call__(self, text: bytes) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        words = WORDS.findall(text.decode("utf-8", "replace").lower())
        h = np.empty(len(words), np.uint32)
        for i, w in enumerate(words):
            c = known.get(w)
            if c is None:
                c = zlib.crc32(w.encode())
                if len(known) <= KNOWN_WORDS and len(w) <= KNOWN_CHARS:
                    known[w] = c
            h[i] = c
        with np.errstate(over="ignore"):
            left, right, over = h * np.uint32(0x9E3779B1), h * np.uint32(0x85EBCA77), h * np.uint32(0xC2B2AE3D)
            mix = lambda x: x ^ (x >> np.uint32(15))
            return np.concatenate([mix(h), mix(left[:-1] + right[1:]), mix(left[:-2] + over[2:])]) & self.mask


def few(at: np.ndarray, most: int) -> np.ndarray:
    """The cells themselves, or of more than most those that a hash makes least, in all texts alike."""
    if len(at) <= most:
        return at
    return np.sort(at[np.argsort(at * np.uint32(0x9E3779B1), kind="stable")[:most]])


def learn(examples: list[np.ndarray], labels: np.ndarray, cells: int = CELLS, passes: int = PASSES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The cells of nonzero weights and the weights; the intercept is cell `cells`."""
    z, n = np.zeros(cells + 1), np.zeros(cells + 1)
    order = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        free = at == cells  # no penalty on the intercept
        penalty = np.where(free, 0.0, L1)
        return np.where(np.abs(zs) <= penalty, 0.0, -(zs - np.sign(zs) * penalty) / ((BETA + np.sqrt(n[at])) / ALPHA + np.where(free, 0.0, L2)))

    texts = np.zeros(cells, np.int32)
    for x in examples:
        texts[x] += 1  # a text's cells are distinct
    examples = [np.append(x[texts[x] >= LEAST_TEXTS], np.uint32(cells)).astype(np.int32) for x in examples]
    for _ in range(passes):
        for i in order.permutation(len(examples)).tolist():
            at = examples[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    some = np.flatnonzero(z)
    w = weights(some)
    return some[w != 0], w[w != 0]


def scorer(at: np.ndarray, weights: np.ndarray, cells: int = CELLS):
    """A function from texts to scores that carries only the nonzero weights."""
    state: dict = {}

    def score(texts: list[bytes]) -> np.ndarray:
        if not state:
            dense = np.zeros(cells + 1)
            dense[at] = weights
            state.update(dense=dense, grams=Grams(cells))
        dense, out = state["dense"], np.empty(len(texts))
        for i, t in enumerate(texts):
            x = state["grams"](t)
            x = np.unique(x[dense[x] != 0])
            out[i] = dense[x].sum() + dense[cells]
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return score


def model(documents: DataFrame, labels: DataFrame, learn_from=None, bound: int = BOUND, cells: int = CELLS, most: int = MOST_CELLS):
    """Fit on the labelled rows that learn_from, a Column, allows: bound texts, most cells of each."""
    grams = Grams(cells)
    rows = sample_labels(labels, "toxic", F.lit(True) if learn_from is None else learn_from, bound)
    found, y = sample_features(documents, rows, lambda t: few(np.unique(grams(t)), most).tobytes(), bound)
    if len({*y.tolist()}) < 2:
        return scorer(np.array([], np.int64), np.array([]), cells)
    at, weights = learn([np.frombuffer(f, np.uint32) for f in found], y, cells)
    del found
    tidy()  # the driver lives on
    return scorer(at, weights, cells)


def toxicity(documents: DataFrame, corpus: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of documents by a model learnt from corpus's labelled rows that aren't held out."""
    out = split(parts, held)
    return score_texts(documents, model(corpus, labels, ~out), out, threshold)
