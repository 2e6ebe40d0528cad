"""What several operators share: reading tables, row keys, word hashes, cut lineage, components."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.plans.sizing import broadcast_if_small, scratch_path, write_and_read

CACHED_WORDS = 200_000  # a task's word caches are emptied when they hold so many entries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they can't already.

    On a cluster whose machines don't share that folder, submit the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def stored(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors."""
    return write_and_read(df, scratch_path(df.sparkSession, name), rows_per_file=rows_per_file)


def text_tag(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text; null texts count as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def crc_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5: one row in five; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def held_out(doc_id: Column) -> Column:
    """A null id is never learned from."""
    return F.coalesce(crc_held_out(doc_id), F.lit(True))


def sample_ids(known: DataFrame, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows of each class of ``known(_id, _y)``, picked by hash of the id.

    The classes are counted first, so that only about twice as many rows as wanted are ever ranked.
    """
    known = stored(known, "sample-known")
    sizes = stored(known.groupBy("_y").agg(F.count(F.lit(1)).alias("_n")), "sample-sizes")
    rank = F.pmod(F.xxhash64("_id"), F.lit(1 << 40))
    # the join goes before any exchange unless there are more classes than a broadcast may hold
    near = known.withColumn("_rank", rank).join(broadcast_if_small(sizes), "_y").where(
        F.col("_rank") < F.lit(2.0 * per_class * (1 << 40)) / F.col("_n"))
    place = F.row_number().over(Window.partitionBy("_y").orderBy("_rank", "_id"))
    return stored(near.withColumn("_place", place).where(F.col("_place") <= per_class).drop("_n"), "sample-ids")


def sample_texts(docs: DataFrame, picked: DataFrame, max_chars: int) -> list[tuple[str, object]]:
    """Texts of the picked rows (by ``sample_ids``, so their number is bounded) and their classes, in
    order of the pick.  A text that exceeds what is left of its class's ``max_chars`` is passed over
    and takes no room; a class of which no words fit gives the first words of its first such text."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    texts = stored(texts.groupBy("_y", "_place").agg(F.min("text").alias("text")), "sample-texts")
    room: dict = {}
    chosen: dict = {}
    passed: dict = {}
    for y, place, n in texts.select("_y", "_place", F.length("text")).orderBy("_y", "_place").collect():
        if n <= room.setdefault(y, max_chars):
            room[y] -= n
            chosen.setdefault(y, set()).add(place)
        else:
            passed.setdefault(y, place)
    for y, place in passed.items():
        if room[y] == max_chars:
            chosen.setdefault(y, set()).add(place)
    if not chosen:
        return []
    wanted = F.lit(False)
    for y, places in chosen.items():
        wanted = wanted | ((F.col("_y") == F.lit(y)) & F.col("_place").isin(places))
    # one character more than there is room for tells whether a text goes on
    found = texts.where(wanted).select(F.substring("text", 1, max_chars + 1).alias("text"), "_y", "_place").orderBy("_place", "_y")
    return [(first_words(r["text"], max_chars), r["_y"]) for r in found.collect()]


def first_words(text: str, most: int) -> str:
    """The text itself, or as many of its first words as ``most`` characters hold; a longer word is cut."""
    if len(text) <= most:
        return text
    cut = text[:most]
    return cut if text[most].isspace() else (cut.rsplit(None, 1)[:-1] or [cut])[0]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for as long as there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each place in a run of words; they follow from the seed.
PLACES = np.random.default_rng(20_240_229).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``offsets`` from each start at which the last of them still exists."""
    n = max(0, len(hashes) - offsets[-1])
    total = np.full(n, np.uint64(len(offsets)))
    for place, offset in enumerate(offsets):
        total += hashes[offset:offset + n] * PLACES[place]
    return mix(total)


def digest(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """One Arrow list for each array."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def repeat_columns(batch: pa.RecordBatch, names: list[str], times: list[int]) -> list[pa.Array]:
    at = pa.array(np.repeat(np.arange(len(times)), times))
    return [batch.column(n).take(at) for n in names]


def pieces(words: list[str], most: int = 20_000) -> Iterator[list[str]]:
    """New words by pieces, as what leads to a word's numbers is much larger than they are."""
    for i in range(0, len(words), most):
        yield words[i:i + most]


def cuts(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to no more than ``most``; a larger row comes alone."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def in_slices(make: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """For mapInArrow: ``make`` gets about a million bytes of column ``text`` at a time (a longer
    text comes alone), so that what it builds from them stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for begin, end in cuts(sizes):
                yield make(batch.slice(begin, end - begin))

    return run


def in_gathered_slices(make: Callable[[pa.Table], pa.RecordBatch], column: str, most: int = 4_000_000):
    """For mapInArrow over many short values: ``make`` gets about ``most`` bytes of ``column`` at a time,
    gathered over batches, so that what it counts is combined well before it is sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            for begin, end in cuts(sizes, most):
                size = sum(sizes[begin:end])
                if held and total + size > most:
                    yield make(pa.Table.from_batches(held))
                    held, total = [], 0
                held.append(batch.slice(begin, end - begin))
                total += size
        if held:
            yield make(pa.Table.from_batches(held))

    return run


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """A table of ``2**bits`` bits, set at the numbers in column ``slot``; at most 2**(bits-6) rows reach
    the driver, whatever the input."""
    marked = slots.groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    found = marked.toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def marked_in(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` of every node in ``edges(a, b)``: nodes are connected iff they share a root.

    Rounds of contraction: every node merges into the neighbour (or itself) that comes first in the
    round's random order, which shrinks any graph by a constant share, paths and stars included.
    Each round's edges and moves are written to the shared folder; nothing but whether edges are
    left reaches the driver.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), f"{name}-edges-0")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    level = 0
    while not edges.isEmpty():
        level += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.xxhash64(F.col("b"), F.lit(level))
        own = F.xxhash64(F.col("a"), F.lit(level))
        best = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("n"))).alias("m"))
        mine = F.struct(own.alias("r"), F.col("a").alias("n"))
        moved = stored(best.select("a", F.least(F.col("m"), mine)["n"].alias("to")), f"{name}-moves-{level}")
        # a node that merges into one that itself merges follows it in the next round
        to = [moved.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        edges = stored(
            edges.join(to[0], "a").join(to[1], "b").where("a_to != b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(),
            f"{name}-edges-{level}")
        roots = roots.join(moved.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(roots, f"{name}-roots")
