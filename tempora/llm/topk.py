"""Exact top-k inner product search with one KD-tree per shard.

Vectors are dealt to shards of about ``SHARD`` by hash of their id.  A shard's tree splits at the median
of the widest dimension until leaves hold at most ``LEAF`` vectors; each node keeps the tight box
around its vectors.  The score of a query with anything in a box is at most
sum(max(q * low, q * high)).  Leaves are visited best first, all queries of a block side by side:
in each round every query that is not done goes to its next best leaves, one at first, then as many as
it has seen, and is done when the bound of the next is below its kth score so far.

The kth score is propagated: a block of queries searches one shard first; the kth scores from there
go with the block to all other shards, and on from shard to shard within a task, so that a box that
can't improve on them is never opened and little is returned.  A kth score goes with its id, so that of
many equal scores only those of smaller ids are looked at again.

Queries are a stated set, in blocks of up to ``LARGE_BLOCK``.  Shards are dealt to up to ``STRIPES``
stripes.  A cell is a block and a stripe: its rows, the block and then the shards one by one, meet in one
exchange and are read as a stream.  There is no join, so nothing is broadcast whatever the planner makes of
the sizes, and a block moves once for each stripe and a shard once for each block.  Memory of a task: one
shard, one block and its ``k`` best.  The best of a query in each stripe are merged by a window.

Scores are exact integers (float products while sums stay below 2**24 or 2**53, integers of any size
beyond).
Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; of rows that repeat an id the least vector takes part; vectors are only compared
with those of as many components; ties go to the smaller id; a query's own id is no candidate; fewer
candidates than k are all returned; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import common

SHARD = 2048
LEAF = 64
BLOCK = 2048  # queries of a block while there are fewer than BLOCKS blocks
BLOCKS = 8
LARGE_BLOCK = 16384
STRIPES = 8
STRIPE = 4  # shards of a stripe while there are fewer than STRIPES stripes
PENDING = 1_000_000  # candidates of a block that are merged at a time
NO_SCORE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max

TREES = "dim int, shard int, ids binary, points binary"
ASKED = "dim int, block int, ids binary, points binary, floors binary, found binary"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def scaled(vectors: DataFrame, vec_id: str, values: str, factor: int) -> DataFrame:
    """``id, v``: floor(factor * component) of the vectors that take part, one per id."""
    v = F.col(f"`{values}`")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.coalesce(good, F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long"))
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def split(points: np.ndarray) -> np.ndarray:
    """Order of the points in which every node of the tree is a range, halved at its middle."""
    order = np.arange(len(points))
    todo = [(0, len(points))]
    while todo:
        begin, end = todo.pop()
        if end - begin > LEAF:
            own = points[order[begin:end]]
            widest = int(np.argmax(own.max(0) - own.min(0))) if own.shape[1] else 0
            middle = (end - begin) // 2
            if own.shape[1]:
                order[begin:end] = order[begin:end][np.argpartition(own[:, widest], middle)]
            todo += [(begin, begin + middle), (begin + middle, end)]
    return order


def leaves(n: int) -> list[tuple[int, int]]:
    out, todo = [], [(0, n)]
    while todo:
        begin, end = todo.pop()
        if end - begin > LEAF:
            middle = begin + (end - begin) // 2
            todo += [(middle, end), (begin, middle)]
        else:
            out.append((begin, end))
    return out


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=1)), -int(x.min(initial=-1)))


class Block:
    """Queries, the ``k`` best found for each of them, and the floor below which nothing counts: a score and
    the id from which on an equal score comes too late."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int):
        self.ids, self.points, self.k = ids, points, k
        self.best, self.best_ids = np.full((len(ids), k), NO_SCORE), np.full((len(ids), k), NO_ID)
        self.n = np.zeros(len(ids), np.int64)
        self.floor, self.floor_id = np.full(len(ids), NO_SCORE), np.full(len(ids), NO_ID)
        self.largest, self.cast = _largest(points), {}

    def take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidates into the best."""
        if not len(q):
            return
        if scores.dtype == object and self.best.dtype != object:
            self.best, self.floor = self.best.astype(object), self.floor.astype(object)
        touched, at = np.unique(q, return_inverse=True)
        row, slot = np.nonzero(np.arange(self.k) < self.n[touched][:, None])
        at = np.concatenate([row, at])
        ids = np.concatenate([self.best_ids[touched[row], slot], ids])
        scores = np.concatenate([self.best[touched[row], slot], scores])
        down = -np.unique(scores, return_inverse=True)[1] if scores.dtype == object else -scores
        order = np.lexsort((ids, down, at))
        at = at[order]
        size = np.bincount(at, minlength=len(touched))
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        kept = place < self.k
        at, place, order = at[kept], place[kept], order[kept]
        self.best[touched[at], place], self.best_ids[touched[at], place] = scores[order], ids[order]
        self.n[touched] = np.minimum(size, self.k)
        full = touched[size >= self.k]
        self.floor[full], self.floor_id[full] = self.best[full, self.k - 1], self.best_ids[full, self.k - 1]

    def meet(self, points: np.ndarray, ids: np.ndarray) -> None:
        """Search a shard."""
        most = self.largest * _largest(points) * max(1, points.shape[1])
        kind = np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else object)
        if kind not in self.cast:
            asked = self.points.astype(kind)
            self.cast = {kind: (asked, np.maximum(asked, asked * 0), np.minimum(asked, asked * 0))}
        asked, above, below = self.cast[kind]
        points = points.astype(kind)
        ranges = leaves(len(points))
        low = np.stack([points[b:e].min(0) for b, e in ranges])
        high = np.stack([points[b:e].max(0) for b, e in ranges])
        bound = above @ high.T + below @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        # a floor that this shard's numbers can't tell apart is beyond all of its scores, and stays so when rounded
        floor = self.floor.astype(kind)
        begin, active = 0, np.arange(len(asked))
        while begin < len(ranges):
            end = min(len(ranges), max(1, 2 * begin))
            active = active[bound[active, begin] >= floor[active]]
            if not len(active):
                break
            row, step = np.nonzero(bound[active, begin:end] >= floor[active][:, None])
            visits = np.zeros((len(ranges), len(asked)), bool)
            visits[order[active[row], begin + step], active[row]] = True
            pending, held = [], 0
            for leaf in np.flatnonzero(visits.any(1)):
                mine = np.flatnonzero(visits[leaf])
                a, b = ranges[leaf]
                scores = asked[mine] @ points[a:b].T
                row, place = np.nonzero(scores >= floor[mine][:, None])
                q, v, s = mine[row], ids[a:b][place], scores[row, place]
                # an equal score counts by its id
                fits = (v != self.ids[q]) & ((s > floor[q]) | (v < self.floor_id[q]))
                s = s[fits] if kind == object else s[fits].astype(np.int64)
                pending.append((q[fits], v[fits], s))
                held += len(s)
                if held >= PENDING:
                    self.take(*map(np.concatenate, zip(*pending, strict=True)))
                    pending, held, floor = [], 0, self.floor.astype(kind)
            if pending:
                self.take(*map(np.concatenate, zip(*pending, strict=True)))
                floor = self.floor.astype(kind)
            begin = end

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's index, id, score) of the best."""
        row, slot = np.nonzero(np.arange(self.k) < self.n[:, None])
        return row, self.best_ids[row, slot], self.best[row, slot]


def search_shard(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, kth: np.ndarray):
    """(query index, id, score) of what reaches the kth scores, and the new kth scores."""
    block = Block(query_ids, queries, k)
    known = kth > -np.inf
    block.floor[known] = kth[known].astype(np.int64)
    block.meet(points, ids)
    none = block.floor == NO_SCORE if block.floor.dtype != object else np.array([x == NO_SCORE for x in block.floor], bool)
    return list(zip(*(x.tolist() for x in block.found()), strict=True)), np.where(none, -np.inf, block.floor)


def _whole(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(np.int64)).tobytes()


def _packed(points: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all; the first byte tells how many."""
    kind = next((k for k in (np.int8, np.int16, np.int32) if _largest(points) <= np.iinfo(k).max), np.int64)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(points.astype(kind)).tobytes()


def _unpacked(ids: bytes, points: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(points, f"i{points[0]}", offset=1).reshape(len(ids), dim)


def _points(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return rows.column("id").to_numpy(), flat.astype(np.int64).reshape(rows.num_rows, rows.column("dim")[0].as_py())


def _tree(rows: pa.Table) -> pa.Table:
    ids, points = _points(rows)
    order = split(points)
    kinds = {"dim": pa.int32(), "shard": pa.int32(), "ids": pa.binary(), "points": pa.binary()}
    row = [rows.column("dim")[0].as_py(), rows.column("shard")[0].as_py(), _whole(ids[order]), _packed(points[order])]
    return pa.table({n: pa.array([x], k) for (n, k), x in zip(kinds.items(), row, strict=True)})


def _asked_row(dim: int, block: int, ids: bytes, points: bytes, floors: bytes | None, found: bytes | None) -> pa.RecordBatch:
    kinds = {"dim": pa.int32(), "block": pa.int32(), **dict.fromkeys(("ids", "points", "floors", "found"), pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((dim, block, ids, points, floors, found), kinds.values(), strict=True)], names=list(kinds))


def _block(rows: pa.Table) -> pa.Table:
    ids, points = _points(rows)
    order = np.argsort(ids)
    return pa.Table.from_batches([_asked_row(rows.column("dim")[0].as_py(), rows.column("block")[0].as_py(), _whole(ids[order]), _packed(points[order]), None, None)])


def _cells(k: int, out):
    """For mapInArrow over the rows of cells, each cell's block before its shards: ``out(row, block)`` of every block."""

    def run(batches):
        cell = row = block = None
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pylist()[0]
                ids, points = _unpacked(one["ids"], one["points"], one["dim"])
                at = (one["dim"], one["block"], one["stripe"])
                if one["shard"] < 0:
                    if block is not None:
                        yield out(row, block)
                    cell, row, block = at, one, Block(ids, points, k)
                    if one["found"] is not None:
                        block.take(*np.frombuffer(one["found"], np.int64).reshape(3, -1))
                    if one["floors"] is not None:
                        block.floor, block.floor_id = np.frombuffer(one["floors"], np.int64).reshape(2, -1).copy()
                elif at == cell:  # else nobody asks
                    block.meet(points, ids)
        if block is not None:
            yield out(row, block)

    return run


def _at_home(row: dict, block: Block) -> pa.RecordBatch:
    """A block's row as it goes on to all other shards."""
    floors, found = np.stack([block.floor, block.floor_id]), np.stack(block.found())
    return _asked_row(row["dim"], row["block"], row["ids"], row["points"], _whole(floors), _whole(found))


def _candidates(row: dict, block: Block) -> pa.RecordBatch:
    q, ids, scores = block.found()
    return pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``vectors`` for each of ``queries`` (both ``id, v``)."""
    common.ship(vectors.sparkSession)
    vectors = common.stored(vectors.withColumn("dim", F.size("v")), "vectors")
    queries = common.stored(queries.withColumn("dim", F.size("v")), "queries")
    shards = max(1, -(-vectors.count() // SHARD))
    n = queries.count()
    blocks = max(1, min(BLOCKS, -(-n // BLOCK)), -(-n // LARGE_BLOCK))
    stripes = min(STRIPES, -(-shards // STRIPE))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    trees = common.stored(dealt.groupBy("dim", "shard").applyInArrow(_tree, TREES), "trees")
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = common.stored(dealt.groupBy("dim", "block").applyInArrow(_block, ASKED), "asked")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    home, stripe = F.pmod("block", F.lit(shards)), F.pmod("shard", F.lit(stripes))

    def met(asked: DataFrame, at: Column, out, shape: str, cells: int) -> DataFrame:
        """``asked`` has a stripe; ``at`` tells which blocks a shard goes to."""
        none = [F.lit(None).cast("binary").alias(c) for c in ("floors", "found")]
        shard = trees.select("*", F.explode(at).alias("block")).select("dim", "block", stripe.alias("stripe"), "shard", "ids", "points", *none)
        rows = asked.select("dim", "block", "stripe", F.lit(-1).alias("shard"), "ids", "points", "floors", "found").unionByName(shard)
        cell = ("dim", "block", "stripe")
        return rows.repartition(cells, *cell).sortWithinPartitions(*cell, "shard").mapInArrow(_cells(k, out), shape)

    at_home = F.pmod(home.cast("int"), F.lit(stripes))
    own = F.filter(every, lambda b: F.pmod(b, F.lit(shards)) == F.col("shard"))
    other = F.filter(every, lambda b: F.pmod(b, F.lit(shards)) != F.col("shard"))
    first = common.stored(met(asked.withColumn("stripe", at_home), own, _at_home, ASKED, blocks), "first")
    spread = first.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    spread = spread.withColumn("found", F.when(F.col("stripe") == at_home, F.col("found")))
    rows = met(spread, other, _candidates, FOUND, blocks * stripes)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
