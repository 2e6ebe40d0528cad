"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct runs of five words (words: what lies between ASCII
blanks, A-Z lower-cased; fewer words: the whole sequence as one run).  Documents are linked if
100 * |intersection| >= 75 * |union|.

*Sketch* (Dahlgaard, Knudsen, Thorup 2017): in round i every element is placed in one of ``COORDINATES``
bins with value (i, random number); a bin keeps its smallest value, so elements of earlier rounds win.
After as many rounds as bins, round COORDINATES + j places every element in bin j: each coordinate is
filled, whatever the size of the set, and agreement of coordinates is concentrated as for independent
samples.  *Bands*: ``BANDS`` runs of ``ROWS`` coordinates; sets with similarity 0.75 share none with
probability (1 - 0.75**4)**40 = 3e-7.

*Exact verification without all pairs.*  Documents of equal word sequence are one class.  Each bucket
(band and value) of two or more classes has a pivot, the member with most company over all its
buckets, so that one heavy group has few pivots.  Every member is compared with the pivots of its
buckets on whole sets.  The links found make first components.  Members of different first
components that share a pivot may still be linked with each other; they are compared through their
differences from the pivot D = (set minus pivot) + (pivot minus set), for which
|X & Y| = |P| - |P - X| - |P - Y| + |Dx & Dy| holds exactly.  A pivot's members are compared block by
block with an inverted index over D, only across components, and only links that join components
are kept.  Then components are made again.  Every pair that shares a bucket is decided that way, and
no task holds more than two blocks of bounded size.

Defined results: a null or empty text has no set, is linked with nothing and is kept; in ``components`` a
row with a null doc_id takes no part: its component_id is null and it is kept (``one_of_each`` counts it
in); rows that repeat a doc_id are
rows of their own that share its number; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm import common

SHINGLE = 5
PERCENT = 75
COORDINATES = 160
ROWS = 4
BANDS = COORDINATES // ROWS
FATE_BITS = 26  # marks of the rows that go or repeat: 8 MB, at any size
BLOCK = 1_000_000  # elements of differences that one block holds


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], hashes: common.WordHashes) -> np.ndarray:
    """The sorted set."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(common.runs(h, tuple(range(min(SHINGLE, len(words))))))


def sketch(items: np.ndarray) -> np.ndarray:
    """``COORDINATES`` values of a non-empty set."""
    t = COORDINATES
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < t:
        # so many rounds at once as fill nearly every bin; a round too many changes nothing
        rounds = np.arange(at, min(t, at + max(1, 8 * t // len(items))), dtype=np.uint64)
        x = common.mix(items[None, :] ^ common.mix(rounds + np.uint64(1))[:, None])
        value = (rounds[:, None] << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, (((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64).ravel(), value.ravel())
        at += len(rounds)
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        x = common.mix(items ^ common.mix(np.uint64([t + j + 1]))) & np.uint64(0xFFFFFFFF)
        out[j] = (np.uint64(t + j) << np.uint64(32)) | x.min()
    return out


def bands(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    return common.signed(common.mix((rows * common.PLACES[:ROWS]).sum(1, dtype=np.uint64) ^ common.mix(np.arange(1, BANDS + 1, dtype=np.uint64))))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, class, n_shingles, bands``: class is the digest of the word sequence (null: none)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = common.WordHashes()
        key, size, rows = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            items = shingles(words, hashes)
            key.append(common.digest(words) if words else None)
            size.append(len(items))
            rows.append(bands(sketch(items)) if len(items) else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(key, pa.binary()), pa.array(size, pa.int64()), common.lists(rows)],
            names=["doc_id", "tag", "class", "n_shingles", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", common.text_tag(F.col("text")).alias("tag"), "text")
    return rows.mapInArrow(common.in_slices(make), f"doc_id {kind}, tag bigint, class binary, n_shingles bigint, bands array<bigint>")


def sets(docs: DataFrame) -> DataFrame:
    """``class, items``"""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = common.WordHashes()
        found = [common.signed(shingles(words_of(t), hashes)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("class"), common.lists(found)], names=["class", "items"])

    return docs.select("class", "text").mapInArrow(common.in_slices(make), "class binary, items array<bigint>")


def pivots(banded: DataFrame) -> DataFrame:
    """``pivot, class``: every class with the pivots of its buckets; ``banded`` has class and bands."""
    member = banded.select("class", F.explode("bands").alias("bucket"))
    sizes = common.stored(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    # joined alike at every size: a broadcast that only small inputs allow would change the plan under way
    held = common.stored(member.join(sizes.hint("merge"), "bucket"), "members")
    company = common.stored(held.groupBy("class").agg(F.sum("n").alias("company")), "company")
    ranked = held.select("bucket", "class").join(company, "class")
    heads = common.stored(ranked.groupBy("bucket").agg(F.max(F.struct("company", "class"))["class"].alias("pivot")), "pivots")
    return held.select("bucket", "class").join(heads, "bucket").where("class != pivot").select("pivot", "class").distinct()


def compared(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs with the size of the pivot's set, what the member lacks and adds, and whether they are linked."""
    both = pairs.join(items, "class").join(items.select(F.col("class").alias("pivot"), F.col("items").alias("p")), "pivot")
    made = both.select("pivot", "class", F.size("p").alias("n_pivot"), F.array_except("p", "items").alias("lacks"), F.array_except("items", "p").alias("adds"))
    # intersection: n_pivot - |lacks|, union: n_pivot + |adds|
    linked = 100 * (F.col("n_pivot") - F.size("lacks")) >= PERCENT * (F.col("n_pivot") + F.size("adds"))
    return made.withColumn("linked", linked)


def join_blocks(block: pd.DataFrame) -> pd.DataFrame:
    """Links across components among the members of a pivot that lie in one block or two.

    Columns: class, root, n_pivot, n_lacks, n_adds, side (0: both blocks are the same), delta.
    """
    n = len(block)
    size = (block.n_pivot - block.n_lacks + block.n_adds).to_numpy()
    lacks, pivot = block.n_lacks.to_numpy(), int(block.n_pivot.iloc[0])
    roots = pd.factorize(block.root)[0]
    deltas = block.delta.tolist()
    lengths = np.array([len(d) for d in deltas])
    keys, items = np.unique(np.concatenate([np.asarray(d, np.int64) for d in deltas]) if lengths.sum() else np.empty(0, np.int64), return_inverse=True)
    owner = np.repeat(np.arange(n), lengths)
    order = np.argsort(items, kind="stable")
    posting, begin = owner[order], np.searchsorted(items[order], np.arange(len(keys) + 1))
    ends = np.cumsum(lengths)
    joined = np.arange(roots.max() + 1)  # components as links are found here

    def top(c: int) -> int:
        while joined[c] != c:
            joined[c] = joined[joined[c]]
            c = joined[c]
        return c

    side = block.side.to_numpy()
    largest = np.bincount(roots).argmax()
    out = []
    for x in np.flatnonzero(roots != largest):
        mine = items[ends[x] - lengths[x]:ends[x]]
        shared = np.zeros(n, np.int64)
        if len(mine):
            shared = np.bincount(np.concatenate([posting[begin[i]:begin[i + 1]] for i in mine]), minlength=n)
        common_items = pivot - lacks[x] - lacks + shared
        linked = (100 * common_items >= PERCENT * (size[x] + size - common_items)) & (roots != roots[x])
        if side.any():
            linked &= side != side[x]
        for y in np.flatnonzero(linked):
            a, b = top(roots[x]), top(roots[y])
            if a != b:
                joined[max(a, b)] = min(a, b)
                out.append((block["class"].iloc[x], block["class"].iloc[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def more_links(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between members of one pivot that are in different components so far."""
    rooted = roots.select(F.col("node").alias("class"), "root")
    delta = F.concat("lacks", "adds")
    member = cells.select("pivot", "class", "n_pivot", F.size("lacks").alias("n_lacks"), F.size("adds").alias("n_adds"), delta.alias("delta"))
    member = member.join(rooted, "class", "left").withColumn("root", F.coalesce("root", "class"))
    member = common.stored(member, "cells")
    # a pivot itself needs no row: it has been compared with every member
    open_ = member.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.size("delta") + 64).alias("n"))
    open_ = common.stored(open_.where("lo != hi").select("pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "open-cells")
    placed = member.join(open_, "pivot").withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("pivot", "class", "root", "n_pivot", "n_lacks", "n_adds", "delta", "own", other)
    spread = spread.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).withColumn(
        "side", F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
    return spread.groupBy("pivot", "i", "j").applyInPandas(join_blocks, "a binary, b binary")


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns."""
    on = F.lit(True)
    for name in names:
        on = on & a[name].eqNullSafe(b[name])
    return on


def grouped(docs: DataFrame, nameless: bool) -> tuple[DataFrame, DataFrame]:
    """(every row's ``doc_id, tag, class, n_shingles``; ``class, doc_id, tag, root`` of every class): the
    id and tag of a class are those of its first row, nulls last; ``nameless``: rows without an id take part."""
    common.ship(docs.sparkSession)
    made = common.stored(classes(docs), "classes")
    named = made.where("class is not null" if nameless else "doc_id is not null and class is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("head")
    heads = common.stored(named.groupBy("class").agg(first).select("class", "head.doc_id", "head.tag"), "heads")
    banded = named.join(heads, (named["class"] == heads["class"]) & same(named, heads, "doc_id", "tag"), "left_semi").select("class", "bands").dropDuplicates(["class"])
    pairs = common.stored(pivots(banded), "pairs")
    involved = pairs.select(F.explode(F.array("pivot", "class")).alias("class")).distinct()
    involved = common.stored(involved.join(heads, "class"), "involved")
    texts = docs.select("doc_id", common.text_tag(F.col("text")).alias("tag"), "text")
    texts = texts.join(involved.hint("merge"), same(texts, involved, "doc_id", "tag")).select("class", "text")
    items = common.stored(sets(texts).dropDuplicates(["class"]), "sets")
    cells = common.stored(compared(pairs, items), "compared")
    links = cells.where("linked").select(F.col("pivot").alias("a"), F.col("class").alias("b"))
    roots = common.components(links, "near")
    rest = common.stored(more_links(cells, roots), "more-links")
    if not rest.isEmpty():
        # only the first components that the new links join are looked at again
        to = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        between = rest.join(to[0], "a", "left").join(to[1], "b", "left").select(
            F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        over = common.components(between, "near-more").select(F.col("node").alias("root"), F.col("root").alias("top"))
        every = roots.select("node", "root").unionByName(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                                                         .join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
        roots = common.stored(every.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "near-roots-all")
    whole = heads.join(roots.withColumnRenamed("node", "class"), "class", "left")
    return made.drop("bands"), common.stored(whole.select("class", "doc_id", "tag", F.coalesce("root", "class").alias("root")), "rooted")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n_shingles, component_id, kept`` of every row."""
    made, rooted = grouped(docs, nameless=False)
    # the smallest doc_id of each component, then of each class
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = common.stored(rooted.join(smallest, "root").select("class", "component_id"), "found")
    out = made.join(found, "class", "left")
    component = F.when(F.col("doc_id").isNull() | F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "tag", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _slot(doc_id: str, tag: str) -> Column:
    """Place of a row's key in the table of marks; rows that share one by chance are told apart by the join."""
    return F.pmod(F.xxhash64(doc_id, tag), F.lit(1 << FATE_BITS))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with its columns: that of the smallest doc_id, rows without
    one last, then of the smallest text hash; of rows equal in both any one.  Rows without words stay."""
    made, rooted = grouped(docs, nameless=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("head")
    heads = rooted.groupBy("root").agg(first).select(F.col("head.doc_id").alias("_id"), F.col("head.tag").alias("_tag"))
    # what becomes of each (doc_id, tag): rows of it go, or all but one
    fate = made.where("class is not null").groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    fate = fate.join(heads.withColumn("_head", F.lit(True)), (fate["doc_id"].eqNullSafe(F.col("_id"))) & (fate["tag"] == F.col("_tag")), "left")
    fate = fate.where("_head is null or n > 1").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.col("_head").isNotNull().alias("_one"))
    fate = common.stored(fate, "fate")
    rows = docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("_row"), docs["doc_id"].alias("_d"), common.text_tag(docs["text"]).alias("_t"))
    on = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tag"))
    # texts of rows that have no fate are never exchanged: only rows whose key is marked meet the fates
    marks = docs.sparkSession.sparkContext.broadcast(common.bit_table(fate.select(_slot("_id", "_tag").alias("slot")), FATE_BITS))
    marked = F.pandas_udf(lambda slot: pd.Series(common.marked_in(marks.value, slot.to_numpy().view(np.uint64))), "boolean")
    rows = rows.withColumn("_may", marked(_slot("_d", "_t")))
    may = rows.where("_may")
    whole = rows.where("not _may").select("_row.*").unionByName(may.join(fate, on, "left_anti").select("_row.*"))
    if fate.where("_one").isEmpty():
        return whole
    repeated = may.join(fate.where("_one"), on, "left_semi").groupBy("_d", "_t").agg(F.first("_row").alias("_row"))
    return whole.unionByName(repeated.select("_row.*"))
