"""Spelling variants: words one code point apart, found with a bit-sliced position index.

Words are maximal runs of letters (``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased) of whole texts; one run in
``EVERY`` (by crc32 of ``<doc_id>:<run>``) loses the code point its crc32 names.  The vocabulary holds the
distinct results of at least ``SHORTEST`` code points with ``LEAST`` occurrences.

*Groups*: a word is cut into ``PIECES`` pieces by its length; an edit leaves all pieces but one as they
are.  A word of ``m`` code points meets words of its own length, and those longer by one, under the keys
"length m without piece j"; it meets the shorter ones under the keys of length m - 1.  Keys are the
strings themselves, so words of one group differ in the open piece only.  A group of more than
``CROWD`` words is cut again by each code point of its open piece; what is left open then is one code
point (two in the longer words), so that no group exceeds the square of the alphabet, whatever the
vocabulary.

*Index*: the words of many groups, laid side by side, give one bitset over the words for each (position,
letter) of the open pieces.  Every word that is the shorter or equal one runs along its letters with all
64 words of a machine word at once: the zero-error set keeps the words equal so far; where a word first
differs it moves to the one-error set, by the same position (replaced) or the next one (inserted),
and stays there as long as the letters at the same, or the shifted, positions agree.  As the edit is taken
at the first difference, a pair turns up in one group only: the one whose open piece holds that place.

*Roots*: forms have at least ``RATIO`` times the occurrences of their word, so chains end after
log(occurrences) steps; pointers are doubled by joins.

Defined results: null and empty texts have no words; rows without a doc_id count with all runs whole;
repeated rows count each; ties go to the smallest form in code-point order; further columns play no part.
Scale: counts are combined by slice and before the shuffle; groups are rows dealt by key; a task holds
``BLOCK`` letters at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import common

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TO_LOWER = {c: c + 32 for c in range(65, 91)}
EVERY = 199
SHORTEST = 6
LEAST = 5
RATIO = 5
PIECES = 3
CROWD = 4096
BLOCK = 200_000


def runs_of(doc_id, text: str | None) -> Counter:
    """The words of a text with their numbers."""
    found = Counter(RUN.findall(text.translate(TO_LOWER))) if text else Counter()
    if doc_id is None:
        return found
    start, words = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        at = h % len(run)
        words[run if h % EVERY else run[:at] + run[at + 1:]] += n
    return words


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n``"""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.update({w: n for w, n in runs_of(doc_id, text).items() if len(w) >= shortest})
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    seen = docs.select("doc_id", "text").mapInArrow(common.in_gathered_slices(make, "text"), "word string, n bigint")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def opened(key: tuple, word: Column, after: Column, over: Column, begin: Column, end: Column, first: Column) -> Column:
    """The key of a word without its code points ``begin`` to ``end`` (places in the shorter words; the
    longer ones, ``over`` = 1, leave out one more), what is left out, and the code point that follows."""
    head, tail = F.substring(word, F.lit(1), begin), F.substring(word, end + over + 1, F.length(word))
    return F.struct(F.concat_ws(" ", *key, head, tail).alias("key"), F.substring(word, begin + 1, end - begin + over).alias("open"),
                    F.when(tail != "", F.substring(tail, 1, 1)).otherwise(after).alias("after"), first.alias("first"))


def keyed(word: Column, shorter: Column) -> Column:
    """The keys of a word among words of length ``shorter`` and those one longer."""
    def one(j: Column) -> Column:
        begin, end = (F.floor(shorter * k / PIECES).cast("int") for k in (j, j + 1))
        return opened((shorter.cast("string"), j.cast("string")), word, F.lit(""), F.length(word) - shorter, begin, end, j == 0)

    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), one)


def recut(rows: DataFrame) -> DataFrame:
    """Rows of groups that are too large, under keys that leave one code point of the open piece open."""
    def one(j: Column) -> Column:
        return opened((F.col("key"), j.cast("string")), F.col("open"), F.col("after"), F.col("over"), j, j + 1, F.col("first") & (j == 0))

    each = F.explode(F.transform(F.sequence(F.lit(0), F.length("open") - F.col("over") - 1), one)).alias("g")
    return rows.select("word", "n", "over", each).select("g.*", "over", "word", "n")


def groups(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``key, open, after, first, over, word, n``: every word under all its keys; groups of one are left out."""
    length = F.length("word")
    made = [words.select("word", "n", F.lit(over).alias("over"), F.explode(keyed(F.col("word"), length - over)).alias("g")) for over in (0, 1)]
    rows = made[0].unionByName(made[1]).select("g.*", "over", "word", "n")
    rows = common.stored(rows, "keys")
    # a group without shorter words holds no pair of its own
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("over").alias("least")).where("size > 1 and least = 0")
    sized = common.stored(rows.join(size.select("key", "size"), "key"), "groups")
    fine = sized.where(F.col("size") <= crowd).drop("size")
    return fine.unionByName(recut(sized.where(F.col("size") > crowd).drop("size")))


class Index:
    """Bitsets over some words, one for each (position, letter) that occurs."""

    def __init__(self, letters: list[np.ndarray], at: np.ndarray, width: int):
        """``letters`` of word i go to bit ``at[i]``; ``width`` machine words."""
        sizes = np.array([len(x) for x in letters])
        place = np.concatenate([np.arange(n) for n in sizes])
        bit = np.repeat(at, sizes)
        name, slot = np.unique(place << 32 | np.concatenate(letters), return_inverse=True)
        self.names, self.bits = name, np.zeros((len(name) + 1, width), np.uint64)  # the last set is empty
        np.bitwise_or.at(self.bits, (slot, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        self.of_size = np.zeros((int(sizes.max()) + 2, width), np.uint64)
        np.bitwise_or.at(self.of_size, (sizes, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))

    def slot(self, place: int, letter: np.ndarray) -> np.ndarray:
        name = place << 32 | letter
        found = np.searchsorted(self.names, name)
        hit = (found < len(self.names)) & (letter >= 0)
        hit[hit] = self.names[found[hit]] == name[hit]
        return np.where(hit, found, len(self.names))

    def near(self, query: np.ndarray, size: np.ndarray, after: np.ndarray, first: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-error sets of queries (rows of letters, -1 beyond their ``size``) in their machine words
        ``cell``: (words with one letter replaced, words with one inserted)."""
        equal, other = self.of_size[size, cell], self.of_size[size + 1, cell]  # zero errors so far, by length
        replaced, inserted = np.zeros_like(equal), np.zeros_like(equal)
        for i in range(query.shape[1] + 1):
            live = i < size
            # behind the last letter stands what follows in all words of the group
            letter = np.where(live, query[:, min(i, query.shape[1] - 1)] if query.shape[1] else after, after)
            same = self.bits[self.slot(i, letter), cell]
            shifted = np.where(live, self.bits[self.slot(i + 1, letter), cell], ~np.uint64(0))
            # an insertion at the very begin belongs to the piece that ends there
            here = np.where((i <= size) & (first | (i > 0)), other & ~same & shifted, np.uint64(0))
            inserted = np.where(live, inserted & shifted, inserted) | here
            replaced = np.where(live, replaced & same | equal & ~same, replaced)
            equal, other = np.where(live, equal & same, equal), np.where(live, other & same, np.uint64(0))
        return replaced, inserted


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def places(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the rows, and begin and end of their groups' bits; groups that fit one machine word lie in one."""
    sizes = [len(list(same)) for _, same in groupby(keys)]
    begins, at = [], 0
    for n in sizes:
        at = at if at % 64 + n <= 64 else -(-at // 64) * 64
        begins.append(at)
        at += n
    begin = np.repeat(begins, sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return begin + np.arange(len(keys)) - first, begin, begin + np.repeat(sizes, sizes)


def links(keys: list[str], open_: list[str], after: list[str], first: list[bool], over: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of (shorter or equal word, near word) among rows that are sorted by key."""
    letters, first = [codes(x) for x in open_], np.array(first)
    size, follow = np.array([len(x) for x in letters]), np.array([ord(x) if x else -1 for x in after])
    bit, begin, end = places(keys)
    row_of = np.full(-(-int(end[-1]) // 64) * 64, -1)
    row_of[bit] = np.arange(len(bit))
    index = Index(letters, bit, len(row_of) // 64)
    asks = np.flatnonzero(np.array(over) == 0)
    asks = asks[np.argsort(size[asks], kind="stable")]  # a block of queries has about one length
    cells = (end[asks] - 1 >> 6) - (begin[asks] >> 6) + 1
    who = np.repeat(asks, cells)
    cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells) + np.repeat(begin[asks] >> 6, cells)
    short, near, a = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while a < len(who):
        b = a + max(1, BLOCK // (int(size[who[a]]) + 1))
        b = a + max(1, int(np.searchsorted(size[who[a:b]], 2 * size[who[a]] + 8, "right")))
        w, c, a = who[a:b], cell[a:b], b
        query = np.full((len(w), int(size[w].max())), -1, np.int64)
        query[np.arange(query.shape[1]) < size[w][:, None]] = np.concatenate([letters[x] for x in w])
        for found in index.near(query, size[w], follow[w], first[w], c):
            on = np.flatnonzero(found)
            q, k = np.nonzero(found[on, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1))
            q, k = on[q], c[on[q]] * 64 + k
            mine = (k >= begin[w[q]]) & (k < end[w[q]])
            short.append(w[q[mine]])
            near.append(row_of[k[mine]])
    return np.concatenate(short), np.concatenate(near)


def _blocks(batches):
    """Whole groups of rows that are sorted by key, about ``BLOCK`` letters at a time."""
    held, letters = [], 0
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "open", "after", "first", "over", "word", "n")), strict=True))
        for row in rows:
            if letters > BLOCK and row[0] != held[-1][0]:
                yield held
                held, letters = [], 0
            held.append(row)
            letters += len(row[1]) + 1
    if held:
        yield held


def _near_rows(batches):
    for held in _blocks(batches):
        keys, open_, after, first, over, word, n = map(list, zip(*held, strict=True))
        short, near = links(keys, open_, after, first, over)
        # replaced: both words ask; inserted: the shorter one asks for both
        grown = np.array(over)[near] == 1
        of, by = np.concatenate([short, near[grown]]), np.concatenate([near, short[grown]])
        rank = np.empty(len(word), np.int64)
        rank[sorted(range(len(word)), key=word.__getitem__)] = np.arange(len(word))
        n = np.array(n)
        order = np.lexsort((rank[by], -n[by], rank[of]))
        of, by = of[order], by[order]
        head = np.flatnonzero(np.concatenate([[True], rank[of][1:] != rank[of][:-1]])) if len(of) else np.empty(0, np.int64)
        count = np.diff(np.concatenate([head, [len(of)]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([word[i] for i in of[head]], pa.string()), pa.array(count, pa.int64()),
             pa.array([word[i] for i in by[head]], pa.string()), pa.array(n[by[head]], pa.int64())],
            names=["word", "near", "best", "best_n"])


def neighbours(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n_near, best, best_n``: how many words are near, and the one of most occurrences."""
    dealt = groups(words, crowd).repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_near_rows, "word string, near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("m")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("m.w").alias("best"), (-F.col("m.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``, which have no cycles: pointers double until all rest."""
    to = common.stored(forms.select("word", F.col("form").alias("root")), "roots-0")
    turn = 0
    while True:
        turn += 1
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = common.stored(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{turn}")
        to = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return to


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word of the vocabulary."""
    common.ship(docs.sparkSession)
    words = common.stored(vocabulary(docs, shortest, least), "vocabulary")
    near = words.join(neighbours(words, crowd), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    near = common.stored(near.select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(good, F.col("best_n")).alias("form_n")), "forms")
    top = roots(near.where("form is not null"))
    return near.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
