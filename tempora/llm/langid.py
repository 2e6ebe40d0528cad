"""Language identification of code-switched text by a linear-chain conditional random field.

Every word (a run of letters, of at most 64) has a label.  Its features are its prefixes and suffixes
of one to three letters, its character 2- and 3-grams, itself, and which languages' lexicons hold it
(words met at least ``LEXICON_LEAST`` times in a language's learning texts).  Features and
transitions between neighbouring labels are learned together by stochastic gradient ascent on the
conditional likelihood, whose gradients come from forward-backward.  Learning sequences are cut from
texts of known language and spliced, so that the transitions learn how seldom languages switch.

A text is labelled by forward-backward over all its words; its language is the one with the largest
sum of word posteriors, its score that sum's share.

Forward-backward is exact for texts of any length, and vectorised: the words of about a million
characters form one chain in which each text's first word forgets what came before; the chain is cut
into blocks whose transfer matrices are multiplied side by side, then the blocks are chained.

The learning sample: per language ``MAX_ROWS`` rows by hash of doc_id, as far as ``MAX_CHARS``
characters go (``common.sample_texts``), never held-out rows or rows without lang.  The languages
are those of the sample.

Defined results: a null text or one without letters is ``und`` with score 0.0; so is every text when
there is nothing to learn from; equal sums go to the language that sorts first; other columns pass
through, except that ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common

MAX_ROWS = 400
MAX_CHARS = 500_000
SLOTS = 1 << 16
LEXICON_LEAST = 3
EPOCHS = 4
RATE = 0.2
DECAY = 1e-6
BLOCK = 128
WORD = re.compile(r"[^\W\d_]{1,64}")
MARKS = np.random.default_rng(23).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # slots x languages
    lexicon: dict[str, int]  # word -> bit set of languages
    lexicon_weights: np.ndarray  # languages x languages
    transitions: np.ndarray
    start: np.ndarray


def words_of(text: str | None) -> list[str]:
    """Runs of letters and of characters that stand among them; numbers of one character (``½``, ``Ⅳ``) are none."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each word's slots, slots): affixes, n-grams and the word itself."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(code)) - starts[word]
    left = sizes[word] - place
    whole = np.add.reduceat(code * MARKS[place % 64], starts)
    of, slots = [np.arange(len(words))], [common.mix(whole)]
    grams = {n: sum((np.pad(code[i:], (0, i)) * MARKS[5 * n + i] for i in range(n)), np.full(len(code), np.uint64(n))) for n in (1, 2, 3)}
    for n, gram in grams.items():
        for kind, at in ((0, np.flatnonzero((place == 0) & (left >= n))), (1, np.flatnonzero(left == n)),
                         (2, np.flatnonzero(left >= n) if n > 1 else np.empty(0, np.int64))):
            of.append(word[at])
            slots.append(common.mix(gram[at] + MARKS[40 + kind]))
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    slot = (np.concatenate(slots) % np.uint64(SLOTS)).astype(np.int64)[order]
    return np.searchsorted(of_all[order], np.arange(len(words))), slot


def chain(psi: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of a chain with potentials ``psi`` (words x labels, positive); where ``first``, a
    sequence begins with ``start`` instead of ``move``.  With ``pairs``, also the summed posteriors
    of neighbouring labels within sequences."""
    n, k = psi.shape
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    # (place in the block, label, block): what is computed side by side lies side by side
    psi = np.ascontiguousarray(np.concatenate([psi, np.ones((pad, k))]).reshape(blocks, BLOCK, k).transpose(1, 2, 0))
    begins = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, BLOCK).T
    begins = [np.flatnonzero(row) for row in begins]
    onward = np.ascontiguousarray(move.T)
    transfer = np.repeat(np.eye(k)[:, :, None], blocks, 2)  # (last label, label before the block, block)
    for t in range(BLOCK):
        step = (onward @ transfer.reshape(k, -1)).reshape(transfer.shape)
        if len(begins[t]):
            step[:, :, begins[t]] = start[:, None, None] * transfer[:, :, begins[t]].sum(0)
        transfer = step * psi[t][:, None, :]
        if t % 8 == 7:
            transfer /= transfer.sum((0, 1))
    by_block = np.ascontiguousarray(transfer.transpose(2, 0, 1))
    enter, leave = np.empty((blocks, k)), np.empty((blocks, k))
    a = np.full(k, 1 / k)
    for c in range(blocks):
        enter[c] = a
        a = by_block[c] @ a
        a /= a.sum()
    b = np.ones(k)
    for c in range(blocks - 1, -1, -1):
        leave[c] = b
        b = b @ by_block[c]
        b /= b.sum()
    forward, before = np.empty_like(psi), np.empty_like(psi)
    a = np.ascontiguousarray(enter.T)
    for t in range(BLOCK):
        before[t] = a
        step = onward @ a
        if len(begins[t]):
            step[:, begins[t]] = start[:, None]
        a = step * psi[t]
        a /= a.sum(0)
        forward[t] = a
    after = np.empty_like(psi)
    b = np.ascontiguousarray(leave.T)
    for t in range(BLOCK - 1, -1, -1):
        after[t] = b
        b = move @ (psi[t] * b)
        if len(begins[t]):
            b[:, begins[t]] = 1.0
        b /= b.sum(0)
    post = forward * after
    post /= post.sum(1, keepdims=True)
    flat = post.transpose(2, 0, 1).reshape(-1, k)[:n]
    if not pairs:
        return flat
    joint = before[:, :, None, :] * move[None, :, :, None] * (psi * after)[:, None, :, :]
    joint /= joint.sum((1, 2), keepdims=True)
    joint = joint.transpose(3, 0, 1, 2).reshape(-1, k, k)[:n]
    return flat, joint[~first].sum(0)


def emissions(words: list[str], model: Model) -> np.ndarray:
    begin, slot = slots_of(words)
    scores = np.add.reduceat(model.weights[slot], begin)
    bits = np.array([model.lexicon.get(w, 0) for w in words])
    return scores + ((bits[:, None] >> np.arange(len(model.langs))) & 1) @ model.lexicon_weights


def potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(1, keepdims=True), -50))


def spliced(sample: list[tuple[str, str]], langs: list[str], rng) -> list[list[tuple[str, int]]]:
    """Sequences of one to four stretches of 8 to 40 words, each from one learning text."""
    stretches = []
    for text, lang in sample:
        words, y = words_of(text), langs.index(lang)
        at = 0
        while at < len(words):
            n = int(rng.integers(8, 41))
            stretches.append([(w, y) for w in words[at:at + n]])
            at += n
    rng.shuffle(stretches)
    sequences, at = [], 0
    while at < len(stretches):
        n = int(rng.integers(1, 5))
        sequences.append([pair for s in stretches[at:at + n] for pair in s])
        at += n
    return sequences


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 5, batch_words: int = 4_000) -> Model | None:
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return None
    k = len(langs)
    counts = [Counter(w for t, lang in sample if lang == own for w in words_of(t)) for own in langs]
    lexicon: dict[str, int] = {}
    for i, count in enumerate(counts):
        for w, n in count.items():
            if n >= LEXICON_LEAST:
                lexicon[w] = lexicon.get(w, 0) | 1 << i
    model = Model(langs, np.zeros((SLOTS, k)), lexicon, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    rng = np.random.default_rng(seed)
    sequences = spliced(sample, langs, rng)
    values = (model.weights, model.lexicon_weights, model.transitions, model.start)
    squares = [np.full_like(v, 1e-8) for v in values]
    for _ in range(epochs):
        rng.shuffle(sequences)
        at = 0
        while at < len(sequences):
            chosen, n = [], 0
            while at < len(sequences) and n < batch_words:
                chosen.append(sequences[at])
                n += len(sequences[at])
                at += 1
            words = [w for s in chosen for w, _ in s]
            if not words:
                continue
            y = np.array([l for s in chosen for _, l in s])
            first = np.zeros(len(words), bool)
            first[np.cumsum([0, *(len(s) for s in chosen[:-1])])] = True
            distinct = list(dict.fromkeys(words))
            place = {w: i for i, w in enumerate(distinct)}
            ids = np.array([place[w] for w in words])
            begin, slot = slots_of(distinct)
            bits = (np.array([lexicon.get(w, 0) for w in distinct])[:, None] >> np.arange(k)) & 1
            scores = np.add.reduceat(model.weights[slot], begin) + bits @ model.lexicon_weights
            post, joint = chain(potentials(scores)[ids], first, np.exp(model.transitions), np.exp(model.start), True)
            error = np.eye(k)[y] - post
            by_word = np.stack([np.bincount(ids, error[:, c], len(distinct)) for c in range(k)], 1)
            of_word = np.repeat(np.arange(len(distinct)), np.diff([*begin, len(slot)]))
            used, where = np.unique(slot, return_inverse=True)
            by_slot = np.stack([np.bincount(where, by_word[of_word, c], len(used)) for c in range(k)], 1)
            inside = np.flatnonzero(~first)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[inside - 1], y[inside]), 1)
            gradients = (None, bits.T @ by_word, seen - joint, error[first].sum(0))
            by_slot -= DECAY * len(words) * model.weights[used]
            squares[0][used] += by_slot ** 2
            model.weights[used] += RATE * by_slot / np.sqrt(squares[0][used])
            for value, gradient, square in list(zip(values, gradients, squares, strict=True))[1:]:
                square += gradient ** 2
                value += RATE * gradient / np.sqrt(square)
    return model


class Labeller:
    """Labels texts with a table of the words met so far, which is emptied when it is full."""

    def __init__(self, model: Model):
        self.model = model
        self.move, self.start = np.exp(model.transitions), np.exp(model.start)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.psi = np.empty((0, len(self.model.langs)))

    def posteriors(self, bags: list[list[str]]) -> np.ndarray:
        if len(self.place) >= common.CACHED_WORDS:
            self.clear()
        new = [w for w in set().union(*bags) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.psi = np.concatenate([self.psi, *(potentials(emissions(part, self.model)) for part in common.pieces(new))])
        words = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(bags)), np.int64)
        first = np.zeros(len(words), bool)
        first[np.cumsum([0, *(len(b) for b in bags[:-1])])] = True
        return chain(self.psi[words], first, self.move, self.start)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        bags = [words_of(t) for t in texts]
        found = [i for i, b in enumerate(bags) if b]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if found:
            full = [bags[i] for i in found]
            post = self.posteriors(full)
            begin = np.cumsum([0, *(len(b) for b in full[:-1])])
            sums = np.add.reduceat(post, begin) / np.array([len(b) for b in full])[:, None]
            best = sums.argmax(1)
            for i, j, row in zip(found, best, sums, strict=True):
                langs[i], scores[i] = self.model.langs[j], min(1.0, float(row[j]))
        return langs, scores


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    known = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(~common.held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    return train(common.sample_texts(docs, common.sample_ids(known, max_rows), max_chars))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    common.ship(docs.sparkSession)
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages, and the sample's lexicon

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        label = Labeller(held.value)
        for texts in parts:
            found = [label(list(texts.iloc[a:b])) for a, b in common.cuts(texts.str.len().fillna(0).tolist())]
            yield pd.DataFrame({"lang_pred": [x for f in found for x in f[0]], "score": [x for f in found for x in f[1]]})

    made = docs.withColumn("_lang", F.pandas_udf(batches, "lang_pred string, score double")(F.col("text")))
    return made.withColumn("lang_pred", F.col("_lang.lang_pred")).withColumn("score", F.col("_lang.score")).drop("_lang")
