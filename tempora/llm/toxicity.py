"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and of its character 3- to 5-grams (with marks at both
ends), looked up by hash, so a misspelling that was never seen shares most of its vectors with the
word it comes from.  A text is the mean of its words, in which common words weigh less
(``w = SMOOTH / (SMOOTH + share of the word in the learning sample)``), n repeats count log(1 + n),
and zero vectors of weight ``NEUTRAL`` keep texts of few words near the bias; a linear softmax over
two classes stands on top.  Vectors and softmax are learned together by gradient descent
on the cross entropy, in which both classes weigh the same; each of the three step sizes falls with
the gradients met so far (one number per matrix, so that rare slots don't take the steps of telling
ones).  Every slot that stands in ``LEAST_TEXTS`` texts of the sample has a vector of its own.

The sample: per class, ``MAX_ROWS`` labelled rows by hash of doc_id, as far as ``MAX_CHARS``
characters go (``common.sample_texts``).  Both are documented bounds on what
the driver holds.  Everything else covers all rows: because the model is linear in the words, a
task needs one number per vector slot, and it scores whole texts word by word.

Defined results: a null text counts as empty; an empty text scores what the bias gives; without any
rows of one of the classes to learn from nothing is known and every score is 0.0; repeated labels
of a doc_id: toxic if one says so; null labels and ids are never learned from; columns of the input
pass through, except that ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common

MAX_ROWS = 1_500
MAX_CHARS = 5_000_000  # per class
SLOTS = 1 << 18
DIM = 8
EPOCHS = 400
TOXIC_WEIGHT = 0.3  # of the loss; the rest is on class 0
RATE = 1.0
DECAY = 1e-6
LEAST_TEXTS = 5  # of the sample hold every slot that has a vector of its own
DENSE = 4_096  # the most widespread slots are held as a dense matrix, all others as a sparse one
SMOOTH = 1e-3
NEUTRAL = 10.0  # weight of the zero vectors that every text is averaged with
WORD = re.compile(r"[^\W\d_]{1,64}")  # a longer run of letters is read as several words
MARKS = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    slot_logit: np.ndarray  # what a slot's vector adds to "class 1 minus class 0"
    bias: float
    share: dict[str, float]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, slot) for each word itself and each of its n-grams, words in order."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(code))  # characters from here to the word's end
    whole = np.add.reduceat(code * MARKS[(sizes[word] - left) % 64], starts)
    found_word, found_slot = [np.arange(len(words))], [common.mix(whole)]
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        total = np.full(len(at), np.uint64(n))
        for i in range(n):
            total += code[at + i] * MARKS[8 * n + i]
        found_word.append(word[at])
        found_slot.append(common.mix(total))
    of_word, slot = np.concatenate(found_word), (np.concatenate(found_slot) % np.uint64(SLOTS)).astype(np.int64)
    order = np.argsort(of_word, kind="stable")
    return of_word[order], slot[order]


class Texts:
    """What texts get from each slot of ``used``, the most widespread first: a dense and a sparse matrix."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], used: np.ndarray, block: int = 1 << 16):
        """``entries`` is emptied, text by text, as the matrices fill."""
        place = np.full(SLOTS, -1, np.int32)
        place[used] = np.arange(len(used))
        self.shape = len(entries), len(used)
        self.dense = np.zeros((len(entries), min(DENSE, len(used))), np.float32)
        sizes = np.array([np.count_nonzero(place[slot] >= DENSE) for slot, _ in entries] + [0])
        end = np.cumsum(sizes)
        slots, values = np.empty(end[-1], np.int32), np.empty(end[-1], np.float32)
        for i in range(len(entries) - 1, -1, -1):
            slot, value = entries.pop()
            at = place[slot]
            near, far = (at >= 0) & (at < DENSE), at >= DENSE
            self.dense[i, at[near]] = value[near]
            slots[end[i] - sizes[i]:end[i]] = at[far] - DENSE
            values[end[i] - sizes[i]:end[i]] = value[far]
        texts = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.argsort(slots, kind="stable").astype(np.int32)
        self.rest = [self._blocks(texts, slots, values, block), self._blocks(slots[order], texts[order], values[order], block)]

    @staticmethod
    def _blocks(to: np.ndarray, of: np.ndarray, value: np.ndarray, block: int) -> list[tuple]:
        """Sorted by ``to``: (where sums go, where they begin, what of, times what)."""
        out = []
        for i in range(0, len(to), block):
            begin = np.flatnonzero(np.diff(to[i:i + block], prepend=-1)).astype(np.int32)
            out.append((to[i:i + block][begin], begin, of[i:i + block], value[i:i + block]))
        return out

    @staticmethod
    def _product(parts: list[tuple], dense: np.ndarray, size: int) -> np.ndarray:
        columns = np.ascontiguousarray(dense.T)  # one by one, which numpy adds up much faster than rows
        out = np.zeros((len(columns), size), np.float32)
        for to, starts, of, value in parts:
            of = of.astype(np.intp)
            for column, total in zip(columns, out, strict=True):
                total[to] += np.add.reduceat(column.take(of) * value, starts)
        return out.T

    def times(self, vectors: np.ndarray) -> np.ndarray:
        wide = self.dense.shape[1]
        return self.dense @ vectors[:wide] + self._product(self.rest[0], vectors[wide:], self.shape[0])

    def back(self, dense: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``dense``."""
        return np.concatenate([self.dense.T @ dense, self._product(self.rest[1], dense, self.shape[1] - self.dense.shape[1])])


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> list[tuple[str, int]]:
    """Whole texts and labels; only rows that are not held out, at most ``max_rows`` per class."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    known = known.where(~common.held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    known = known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    return common.sample_texts(docs, common.sample_ids(known, max_rows), max_chars)


def train(sample: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    if len({y for _, y in sample}) < 2:
        return None
    vocabulary: dict[str, int] = {}
    bags = []
    for text, _ in sample:
        bag = Counter(words_of(text))
        at = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in bag), np.int32, len(bag))
        bags.append((at, np.fromiter(bag.values(), np.float32, len(bag))))
    counts = np.zeros(len(vocabulary))
    for at, times in bags:
        counts[at] += times
    share = counts / max(1.0, counts.sum())
    weight = SMOOTH / (SMOOTH + share)
    every, slot, sizes = list(vocabulary), [], []
    for i in range(0, len(every), 20_000):  # by pieces, as what leads to the slots is much larger than they are
        of_word, found = slots_of(every[i:i + 20_000])
        slot.append(found.astype(np.int32))
        sizes.append(np.bincount(of_word, minlength=len(every[i:i + 20_000])))
    slot, begin = np.concatenate([*slot, np.empty(0, np.int32)]), np.concatenate([[0], *sizes]).cumsum()

    # texts by slots: what a text gets from each slot's vector when its words are averaged
    entries, seen = [], np.zeros(SLOTS, np.int64)
    bags.reverse()
    while bags:
        at, times = bags.pop()
        part = np.log1p(times) * weight[at]
        n = begin[at + 1] - begin[at]
        places = np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        slots, where = np.unique(slot[places], return_inverse=True)
        values = np.bincount(where, np.repeat(part / np.maximum(n, 1) / (part.sum() + NEUTRAL), n), len(slots))
        entries.append((slots.astype(np.int32), values.astype(np.float32)))
        seen[slots] += 1
    used = np.argsort(-seen, kind="stable")
    used = used[seen[used] >= LEAST_TEXTS]
    texts = Texts(entries, used)

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    top = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    y = np.array([c for _, c in sample])
    rows = np.where(y == 1, TOXIC_WEIGHT / (y == 1).sum(), (1 - TOXIC_WEIGHT) / (y == 0).sum()).astype(np.float32)
    squares = [np.full_like(a, 1e-10) for a in (vectors, top, bias)]
    for _ in range(epochs):
        hidden = texts.times(vectors)
        logits = hidden @ top + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= rows[:, None]
        gradients = (texts.back(p @ top.T) + DECAY * vectors, hidden.T @ p, p.sum(0))
        for value, gradient, square in zip((vectors, top, bias), gradients, squares, strict=True):
            square += gradient * gradient
            value -= RATE * gradient / np.sqrt(square)
    slot_logit = np.zeros(SLOTS, np.float32)
    slot_logit[used] = vectors @ (top[:, 1] - top[:, 0])
    common_words = {w: float(share[i]) for w, i in vocabulary.items() if counts[i] > 1}
    return Model(slot_logit, float(bias[1] - bias[0]), common_words)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    return train(learning_sample(docs, labels, label, max_rows, max_chars))


class Scorer:
    """Scores texts with a table of the words met so far, which is emptied when it is full."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.weight = self.logit = np.empty(0)

    def learn(self, new: list[str]) -> None:
        of_word, slot = slots_of(new)
        n = np.bincount(of_word, minlength=len(new))
        mean = np.bincount(of_word, self.model.slot_logit[slot], len(new)) / np.maximum(n, 1)
        weight = np.array([SMOOTH / (SMOOTH + self.model.share.get(w, 0.0)) for w in new])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.weight, self.logit = np.concatenate([self.weight, weight]), np.concatenate([self.logit, weight * mean])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        bags = [Counter(words_of(t)) for t in texts]
        if len(self.place) >= common.CACHED_WORDS:
            self.clear()
        for new in common.pieces([w for w in set().union(*bags) if w not in self.place]):
            self.learn(new)
        out = np.full(len(texts), self.model.bias)
        for i, bag in enumerate(bags):
            if bag:
                at = np.fromiter(map(self.place.__getitem__, bag), np.int64, len(bag))
                times = np.log1p(np.fromiter(bag.values(), float, len(bag)))
                out[i] += times @ self.logit[at] / (times @ self.weight[at] + NEUTRAL)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5)."""
    common.ship(docs.sparkSession)
    if model is None:
        scored = docs.withColumn("score", F.lit(0.0))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers and the sample's words

        def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = Scorer(held.value)
            for texts in parts:
                scores = [scorer(list(texts.iloc[a:b])) for a, b in common.cuts(texts.str.len().fillna(0).tolist())]
                yield pd.Series(np.concatenate([*scores, np.empty(0)]))

        scored = docs.withColumn("score", F.pandas_udf(batches, "double")(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their columns."""
    rows = docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("_row"), docs["text"].alias("text"))
    return score(rows, model).where("predicted = 0").select("_row.*")
