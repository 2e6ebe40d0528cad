"""Benchmark decontamination by spaced-seed hashing.

Texts are read as words: ASCII letters lower-cased, ASCII punctuation and blanks between them.  A
document overlaps a benchmark item if some ``WINDOW`` consecutive words of the item stand in it at
the same distance from each other, with at most ``SUBSTITUTIONS`` words replaced; an item of fewer
words must stand in it whole and unchanged, at whatever length: ``LEAST_WORDS``, 1, leaves out none.

``MASKS`` are spaced seeds: fixed patterns of seven word positions with ignored ones between.  Wherever
two or fewer of 13 words are replaced, at least one mask still fits between them (a test goes through
all cases), so no overlap is missed.  Hashes of all masks at all places of the test items are joined
with those of all documents; each hit names a diagonal (document place minus item place), and each
distinct diagonal is verified word by word.

Scale: the hashes of the documents are looked up in a Bloom filter of the items' hashes first, whose
size is fixed (2**26 bits, 8 MB) however many items there are; it lets through all hits and, with so
many items that it fills up, more of the rest, which the join drops.  Hits that lie close together
travel as one region with the words around them, so that verification needs no text again.  Seeds,
diagonals and regions are rows of tables; what one document or one item has of them is bounded by
its own length.

Defined results: null and empty texts and items overlap nothing; a very short item overlaps every
document that holds its words in a row (``least_words`` of ``overlaps`` and ``clean`` leaves such items
out, where a caller wants that); repeated items are each reported; repeated rows
of a document are reported once; rows with a null doc_id are reported with it; extra columns are
left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import common

# The masks, as positions that count.  Found by greedy cover of all pairs of
# replaced words among 13.
MASKS = (
    (0, 1, 2, 3, 5, 6, 7),
    (0, 1, 2, 4, 7, 8, 9),
    (0, 1, 2, 3, 4, 5, 6),
    (0, 1, 2, 4, 5, 6, 7),
)
WINDOW = 13
SUBSTITUTIONS = 2
LEAST_WORDS = 1  # of an item that is searched
BITS = 26
MERGE = 32  # hits this close together travel as one region

_SEPARATORS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b for b in _SEPARATORS)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split()


def masks_for(lengths: list[int]) -> list[tuple[int, ...]]:
    """The masks, and for each length of items shorter than a window the whole item."""
    return [*MASKS, *(tuple(range(n)) for n in sorted(set(lengths)) if 0 < n < WINDOW)]


def seeds(hashes: np.ndarray, masks: list[tuple[int, ...]]) -> list[tuple[int, np.ndarray]]:
    """For each mask its number and the hash at every place where it fits."""
    return [(m, common.mix(common.runs(hashes, mask) + np.uint64(m + 1))) for m, mask in enumerate(masks)]


def aligned(document: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """First place, places and equal words of the longest overlap of two runs laid along each other;
    ``least`` is the item's whole length."""
    same = document == item
    window, allowed = (WINDOW, SUBSTITUTIONS) if least >= WINDOW else (least, 0)
    misses = np.concatenate([[0], np.cumsum(~same)])
    good = np.flatnonzero(misses[window:] - misses[:-window] <= allowed)
    best = None
    for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else []:
        inside = np.flatnonzero(same[run[0]:run[-1] + window]) + run[0]
        begin, n = int(inside[0]), int(inside[-1] - inside[0] + 1)
        if best is None or n > best[1]:
            best = begin, n, len(inside)
    return best


def regions_of(places: np.ndarray, n_words: int) -> list[tuple[int, int, np.ndarray]]:
    """(begin, end, places) of words around hits that lie at most ``MERGE`` apart."""
    found = np.unique(places)
    return [(max(0, int(g[0]) - WINDOW), min(n_words, int(g[-1]) + 2 * WINDOW), g)
            for g in np.split(found, np.flatnonzero(np.diff(found) > MERGE) + 1)]


def item_table(items: DataFrame, least_words: int) -> DataFrame:
    """``item`` (digest of the words), ``words`` (their hashes): each distinct text once."""

    def run(batches):
        for batch in batches:
            hashes = common.WordHashes()
            cut = [words_of(t or "") for t in batch.column("text").to_pylist()]
            at = [i for i, w in enumerate(cut) if len(w) >= max(1, least_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(at, pa.int64())), pa.array([common.digest(cut[i]) for i in at], pa.binary()),
                 common.lists([common.signed(hashes.of(cut[i])) for i in at])], names=["item_id", "item", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, item binary, words array<bigint>")


def overlaps(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, item_id, first_word, n_words, n_equal``: one row per document row and item it holds.

    The place is that of the longest overlap with the item (ties: the first one), in the document's
    words counted from 0.
    """
    common.ship(docs.sparkSession)
    spark = docs.sparkSession
    named = common.stored(item_table(items, least_words), "items")
    distinct = common.stored(named.groupBy("item").agg(F.first("words").alias("words")), "items-distinct")
    lengths = [r[0] for r in distinct.select(F.size("words").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]  # at most 12 numbers
    masks = masks_for(lengths)

    def item_seeds(batches):
        for batch in batches:
            rows = [(item, m, place, h) for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for m, found in seeds(np.array(words, np.int64).view(np.uint64), masks) if m < len(MASKS) or len(words) == len(masks[m])
                    for place, h in enumerate(common.signed(found).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())],
                names=["item", "item_place", "seed"])

    seeded = common.stored(distinct.mapInArrow(item_seeds, "item binary, item_place int, seed bigint"), "item-seeds")
    # a Bloom filter of fixed size, in words of 64 bits; at most 2**(BITS-6) rows reach the driver
    bit = F.explode(F.array(F.shiftrightunsigned("seed", 64 - BITS), F.col("seed").bitwiseAND((1 << BITS) - 1)))
    marked = seeded.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    found = marked.toArrow()
    bitmap = np.zeros(1 << BITS - 6, np.uint64)
    bitmap[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(bitmap)

    def marked_in(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0

    def regions(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bits = common.WordHashes(), held.value
        row, begin_at, words_at, hits_at = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            words = hashes.of(words_of(text or ""))
            places, found = [], []
            for _, seed in seeds(words, masks):
                on = marked_in(bits, seed >> np.uint64(64 - BITS))
                on &= marked_in(bits, seed & np.uint64((1 << BITS) - 1))
                places.append(np.flatnonzero(on))
                found.append(seed[on])
            places, found = np.concatenate(places), common.signed(np.concatenate(found))
            for begin, end, inside in regions_of(places, len(words)) if len(places) else []:
                mine = (places >= inside[0]) & (places <= inside[-1])
                row.append(i)
                begin_at.append(begin)
                words_at.append(common.signed(words[begin:end]))
                hits_at.append([{"place": a, "seed": b} for a, b in zip(places[mine].tolist(), found[mine].tolist(), strict=True)])
        at = pa.array(row, pa.int64())
        hit = pa.list_(pa.struct([("place", pa.int32()), ("seed", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("tag").take(at), pa.array(begin_at, pa.int32()), common.lists(words_at), pa.array(hits_at, hit)],
            names=["doc_id", "tag", "begin", "words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", common.text_tag(F.col("text")).alias("tag"), "text")
    around = rows.mapInArrow(common.in_slices(regions), f"doc_id {kind}, tag bigint, begin int, words array<bigint>, hits array<struct<place:int,seed:bigint>>")
    region = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tag", "begin")
    around = common.stored(around.withColumn("region", region), "regions")
    hits = around.select("region", F.explode("hits").alias("hit")).select("region", "hit.place", "hit.seed")
    diagonals = hits.join(seeded, "seed").select("region", "item", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    diagonals = common.stored(diagonals, "diagonals")
    laid = diagonals.join(around.drop("hits"), "region").join(distinct.withColumnRenamed("words", "item_words"), "item")

    def verify(batches):
        for batch in batches:
            found, at = [], []
            columns = [batch.column(n).to_pylist() for n in ("begin", "words", "item_words", "diagonal")]
            for i, (begin, words, item, diagonal) in enumerate(zip(*columns, strict=True)):
                first = max(0, begin - diagonal)  # of the item's words, the first that the region may hold
                last = min(len(item), begin + len(words) - diagonal)
                shift = diagonal - begin
                hit = aligned(np.array(words[first + shift:last + shift]), np.array(item[first:last]), len(item)) if last > first else None
                if hit:
                    at.append(i)
                    found.append((hit[0] + first + diagonal, hit[1], hit[2]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).take(pa.array(at, pa.int64())) for n in ("doc_id", "tag", "item")]
                + [pa.array([f[j] for f in found], pa.int32()) for j in range(3)],
                names=["doc_id", "tag", "item", "first_word", "n_words", "n_equal"])

    shape = f"doc_id {kind}, tag bigint, item binary, first_word int, n_words int, n_equal int"
    checked = laid.select("doc_id", "tag", "item", "begin", "words", "item_words", "diagonal").mapInArrow(verify, shape)
    best = F.min(F.struct((-F.col("n_words")).alias("l"), F.col("first_word").alias("f"), F.col("n_equal").alias("e"))).alias("best")
    whole = checked.groupBy("doc_id", "tag", "item").agg(best)
    return whole.join(named.select("item_id", "item").distinct(), "item").select(
        "doc_id", "tag", "item_id", F.col("best.f").cast("long").alias("first_word"), (-F.col("best.l")).cast("long").alias("n_words"),
        F.col("best.e").cast("long").alias("n_equal"))


def clean(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with their columns."""
    held = common.stored(overlaps(docs, items, least_words).select("doc_id", "tag").distinct(), "contaminated")
    held = held.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    on = docs["doc_id"].eqNullSafe(held["_id"]) & (common.text_tag(docs["text"]) == held["_tag"])
    return docs.join(held, on, "left_anti")
