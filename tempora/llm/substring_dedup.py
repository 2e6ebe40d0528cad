"""Substring dedup by seed and extend: words of passages that stand elsewhere too are removed.

Words are what lies between ASCII blanks.  A passage repeats if ``LENGTH`` consecutive words of one
document also start anywhere else, in the same document or another one.

*Seeds*: of every ``LENGTH`` consecutive words the run of ``SEED`` words with the smallest hash is an
anchor (the leftmost of equal ones), so equal passages have equal anchors at equal places, and one
run of words in some thirteen is an anchor.  Anchors are joined across all documents; one that
occurs once seeds nothing.
*Extension*: a seed is extended to both sides over every window of ``LENGTH`` words whose anchor it
is; the windows of all seeds are joined by 128 bits of all their words, which tells how far matches
reach left and right.  Windows that match nothing are dropped.  Documents all of whose anchors stand
alone are done with after the first step.
*Maximal repeats*: what is left is merged to the longest stretches of words, at least ``LENGTH`` long.

No pairs are made: both joins are counts of equal hashes.  A hash that occurs once carries its only
place along as the minimum of its places, so what is *not* repeated comes straight out of the count,
and goes back to its document.  Counts are combined before the shuffle, so a passage in a third of
all documents is one row per task.  Documents of equal word sequence count with their number and only
the first of them is looked at.  Texts are shuffled once, by document; both later steps read that
exchange.

Defined results: a null or empty text has no words; shorter texts than ``LENGTH`` lose nothing; rows
that repeat a doc_id, or have none, are documents of their own (doc_ids are integers); extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import common

LENGTH = 35
SEED = 10
SPAN = LENGTH - SEED + 1  # runs of SEED words in a window


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


PLACE_BITS = 28  # no text has so many words


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of SEED words, place of the anchor of every window)."""
    if len(hashes) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = common.runs(hashes, tuple(range(SEED)))
    # the smallest of SPAN neighbours by doubling; the place in the low bits makes the leftmost win
    least = grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[:width - SPAN], least[SPAN - width:])
    return grams, (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


class Digests:
    """Two 64-bit hashes of words, remembered for as long as there is room."""

    def __init__(self):
        self.first, self.second = common.WordHashes(), SecondHashes()

    def windows(self, words: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the windows that begin at these places, in two halves."""
        places = tuple(range(LENGTH))
        return tuple(common.signed(common.runs(h.of(words), places)[at]) for h in (self.first, self.second))


class SecondHashes(common.WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= common.CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, 1)
        if len(word) <= 64:
            self[word] = h
        return h


def _key(batch: pa.RecordBatch, rows: list[int]) -> list[pa.Array]:
    at = pa.array(rows, pa.int64())
    return [batch.column("key").take(at), batch.column("tag").take(at)]


def _seed_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, row, place, found, total = common.WordHashes(), [], [], [], []
    for i, text in enumerate(batch.column("text").to_pylist()):
        grams, at = anchors(hashes.of(words_of(text)))
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]  # places of anchors never go back
        row.extend([i] * len(at))
        place.append(at)
        found.append(grams[at])
        total.append(np.full(len(at), len(at)))
    place, total = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (place, total))
    found = common.signed(np.concatenate([*found, np.empty(0, np.uint64)]))
    return pa.RecordBatch.from_arrays([*_key(batch, row), pa.array(place, pa.int32()), pa.array(total, pa.int32()), pa.array(found)],
                                      names=["key", "tag", "place", "anchors", "hash"])


def _class_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [words_of(t) for t in batch.column("text").to_pylist()]
    found = [common.digest(w) if len(w) >= LENGTH else None for w in words]
    return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tag"), pa.array(found, pa.binary())], names=["key", "tag", "class"])


def seeded(hashes: np.ndarray, single: list[int]) -> np.ndarray:
    """Places of the windows whose anchor occurs elsewhere too."""
    _, at = anchors(hashes)
    return np.flatnonzero(~np.isin(at, single)) if len(at) else at


def _window_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    digests, row, place, found, copies = Digests(), [], [], ([], []), []
    for i, (text, single, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "single", "copies")), strict=True)):
        words = words_of(text)
        at = seeded(digests.first.of(words), single or [])
        if len(at):
            row.extend([i] * len(at))
            place.append(at)
            for half, h in zip(found, digests.windows(words, at), strict=True):
                half.append(h)
            copies.append(np.full(len(at), n, np.int64))
    place, copies, *halves = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (place, copies, *found))
    return pa.RecordBatch.from_arrays([*_key(batch, row), pa.array(place, pa.int32()), *map(pa.array, halves), pa.array(copies)],
                                      names=["key", "tag", "place", "hash", "other", "copies"])


def maximal(covered: np.ndarray) -> list[tuple[int, int]]:
    """(first word, words) of the longest stretches of covered words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


def _result_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, n_words, spans, kept = common.WordHashes(), [], [], []
    columns = (batch.column(c).to_pylist() for c in ("text", "single", "alone", "unmatched", "repeated"))
    for text, single, alone, unmatched, repeated in zip(*columns, strict=True):
        words = words_of(text)
        covered = np.zeros(len(words), bool)
        if repeated and len(words) >= LENGTH:
            covered[:] = True
        elif not repeated and not alone:  # alone: no anchor stands elsewhere
            starts = np.setdiff1d(seeded(hashes.of(words), single or []), unmatched or [])
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + LENGTH, -1)
            covered = np.cumsum(edge[:-1]) > 0
        n_words.append(len(words))
        spans.append([{"first_word": a, "n_words": n} for a, n in maximal(covered)])
        kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]).decode())
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "repeats", "kept_text"])


def _singles(rows: DataFrame, name: str, count: Column, *of: str, total: str | None = None) -> DataFrame:
    """Per document the places of hashes (columns ``of``) that occur once; ``alone``: all ``total`` of them do."""
    carried = ["key", "tag", "place", *([total] if total else [])]
    counted = rows.groupBy(*of).agg(count.alias("n"), *(F.min(c).alias(c) for c in carried))
    alone = (F.count(F.lit(1)) == F.min(total)) if total else F.lit(False)
    return counted.where("n = 1").groupBy("key", "tag").agg(F.collect_list("place").alias(name), alone.alias("alone"))


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, repeats (first_word, n_words), kept_text``: one row per row of ``docs``."""
    common.ship(docs.sparkSession)
    # key and tag tell documents apart; rows without an id are told apart by their text alone
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", key.alias("key"), common.text_tag(F.col("text")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    classes = common.stored(rows.mapInArrow(common.in_slices(_class_rows), "key bigint, tag bigint, class binary").where("class is not null"), "classes")
    firsts = classes.groupBy("class").agg(F.min(F.struct("key", "tag")).alias("k"), F.count(F.lit(1)).alias("copies"))
    firsts = common.stored(firsts.select("class", "k.key", "k.tag", "copies"), "firsts")
    copied = common.stored(classes.join(firsts.where("copies > 1").select("class"), "class").select("key", "tag", F.lit(True).alias("repeated")).distinct(), "copied")
    single = _singles(rows.mapInArrow(common.in_slices(_seed_rows), "key bigint, tag bigint, place int, anchors int, hash bigint"), "single", F.count(F.lit(1)), "hash", total="anchors")
    # of documents all of whose anchors stand alone the places don't matter
    single = common.stored(single.select("key", "tag", F.when(~F.col("alone"), F.col("single")).alias("single"), "alone"), "single-seeds")
    spread = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "tag")
    looked_at = spread.join(firsts.select("key", "tag", "copies"), ["key", "tag"]).join(single, ["key", "tag"], "left").where("alone is null or not alone")
    windows = looked_at.mapInArrow(common.in_slices(_window_rows), "key bigint, tag bigint, place int, hash bigint, other bigint, copies bigint")
    unmatched = _singles(windows, "unmatched", F.sum("copies"), "hash", "other").drop("alone")
    told = spread.join(single, ["key", "tag"], "left").join(copied, ["key", "tag"], "left").join(unmatched, ["key", "tag"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return told.mapInArrow(common.in_slices(_result_rows), f"doc_id {kind}, n_words bigint, repeats array<struct<first_word:bigint,n_words:bigint>>, kept_text string")
