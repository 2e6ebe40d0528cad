"""Phrase collocations by prefix-free parsing of the texts.

Texts (A-Z lower-cased) are cut at ``[.,;:!?]`` and line ends into pieces, pieces at blanks and tabs
into words.  A document is read as its words with a break for every end of a piece, closed by
``OVERLAP`` breaks.

*Parse*: wherever the hash of ``OVERLAP`` consecutive tokens is divisible by ``EVERY`` a chunk begins; it
reaches to the end of the next such run, so neighbouring chunks overlap by ``OVERLAP`` tokens and where
they begin depends on the content alone: what documents share is cut alike.  The *dictionary* holds
each distinct chunk of a language once with its frequency in the parse.  A phrase of up to
``OVERLAP`` + 1 words belongs to the chunk in which it begins before the closing run; every occurrence
so lies whole in one chunk and counts once, times the chunk's frequency.

*Counting* goes by levels over the dictionary: words, then pairs of frequent words, then phrases of
three and four words all of whose pairs are frequent.  Which words and pairs are frequent is told to
the tasks by a table of ``BITS`` bits of fixed size; a slot shared by chance only lets a phrase be
counted that the threshold then drops, so counts are exact, of words and not of hashes, at any size.

*Scores*: a candidate's cuts are joined with the counts of their two parts; the lowest-scoring cut
holds.  Products are decimals of 38 digits.  A candidate inside a longer one that is nearly as
frequent goes.  The first ``top`` of each language are found by rounds over salted parts of bounded size.

Scale: chunks and counts are combined in slices of some megabytes and again before each shuffle, so a
hot word, line or chunk is one row a slice; no task holds more than a slice or one text.

Defined results: null and empty texts have no words; a null language counts as ``und``, together with
rows that say so; repeated rows count each; languages without a phrase frequent enough have no rows;
doc_ids and further columns play no part.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm import common

LEAST = 30
TOP = 2000
WITHIN = 80  # percent of a phrase's occurrences that lie in a longer one
SCALE = 2_000_000
LONGEST = 4
OVERLAP = LONGEST - 1
EVERY = 32
BITS = 26
PART = 50_000  # candidates of a language that one task ranks

BREAK = b"\xff"  # no byte of any text
_TO_TOKENS = bytes(b + 32 if 65 <= b <= 90 else 0x20 if b == 9 else 0xFF if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_TOKENS).replace(BREAK, b" \xff ").split() if text else []


def chunks(tokens: list[bytes], hashes: common.WordHashes) -> list[bytes]:
    """The parse of one document: chunks as tokens joined by a blank."""
    if not tokens:
        return []
    stream = [*tokens, *[BREAK] * OVERLAP]
    triggers = np.flatnonzero(common.runs(hashes.of(stream), tuple(range(OVERLAP)))[:len(tokens)] % np.uint64(EVERY) == 0)
    begins = np.concatenate([[0], triggers[triggers > 0]])
    offset = np.cumsum(np.fromiter(map(len, stream), np.int64, len(stream)) + 1)  # where the token after each one begins
    ends = offset[np.concatenate([begins[1:], [len(tokens)]]) + OVERLAP - 1] - 1
    begins = np.where(begins > 0, offset[begins - 1], 0)
    text = b" ".join(stream)
    return [text[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


def dictionary(docs: DataFrame) -> DataFrame:
    """``lang, chunk, n``: each distinct chunk of a language with its parse frequency."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, found = common.WordHashes(), Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.update((lang, chunk) for chunk in chunks(tokens_of(text), hashes))
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
            names=["lang", "chunk", "n"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    cut = rows.mapInArrow(common.in_gathered_slices(make, "text"), "lang string, chunk binary, n bigint")
    return cut.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


class Slice:
    """The tokens of some chunks of one language, as codes of its distinct words."""

    def __init__(self, lang: str, chunk: pa.Array, n: np.ndarray):
        tokens = pc.split_pattern(chunk, " ")
        coded = tokens.values.dictionary_encode()
        sizes = np.diff(tokens.offsets.to_numpy())
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.weight = np.repeat(n, sizes)
        last = np.repeat(np.cumsum(sizes), sizes)  # a phrase that begins in the closing run belongs to the next chunk
        self.own = np.arange(len(self.codes)) < last - OVERLAP
        self.word = self.codes != pc.index(self.words, pa.scalar(BREAK, pa.binary())).as_py()
        self.lang = lang

    @cached_property
    def hash(self) -> np.ndarray:
        return common.WordHashes().of(self.words.to_pylist())

    def slots(self, *codes: np.ndarray) -> np.ndarray:
        return slots(self.lang, [self.hash[c] for c in codes])

    def ahead(self, x: np.ndarray, by: int) -> np.ndarray:
        """``x`` at the token so many places on; nothing beyond the end belongs to an own phrase."""
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])

    def sums(self, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct key among the places ``at``, its summed weight)."""
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        return at[first], np.add.reduceat(self.weight[at], first) if len(first) else np.empty(0, np.int64)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.codes[at + i])).cast(pa.string()) for i in range(size)]
        return pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]


def slots(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """The bit of the words with these hashes, in this order, in this language."""
    total = common.WordHashes().of([lang.encode()])[0] + np.uint64(len(hashes))
    for place, h in enumerate(hashes):
        total = total + h * common.PLACES[place]
    return common.mix(total) >> np.uint64(64 - BITS)


def words(s: Slice) -> list[tuple]:
    at = np.flatnonzero(s.own & s.word)
    at, n = s.sums(s.codes[at], at)
    return [(s.phrases(at, 1), 1, n), (pa.nulls(1, pa.string()), 1, np.array([n.sum()]))]  # the null phrase: all words


def pairs(s: Slice, table: np.ndarray) -> list[tuple]:
    good = common.marked_in(table, s.slots(np.arange(len(s.words))))[s.codes] & s.word
    at = np.flatnonzero(s.own & good & s.ahead(good, 1))
    at, n = s.sums(s.codes[at] * len(s.words) + s.codes[at + 1], at)
    return [(s.phrases(at, 2), 2, n)]


def longer(s: Slice, table: np.ndarray) -> list[tuple]:
    after = s.ahead(s.codes, 1)
    both = np.flatnonzero(s.word & s.ahead(s.word, 1))
    both = both[common.marked_in(table, s.slots(s.codes[both], after[both]))]
    pair = np.full(len(s.codes), -1)  # the number of the frequent pair that begins here
    pair[both] = np.unique(s.codes[both] * len(s.words) + after[both], return_inverse=True)[1]
    good, out = pair >= 0, []
    for size in range(3, LONGEST + 1):
        on = s.own.copy()
        for i in range(size - 1):
            on &= s.ahead(good, i)
        at = np.flatnonzero(on)
        key = pair[at] * len(pair) + pair[at + 2] if size == 4 else pair[at] * len(s.words) + s.codes[at + 2]
        at, n = s.sums(key, at)
        out.append((s.phrases(at, size), size, n))
    return out


def counted(chunks: DataFrame, level, table: np.ndarray | None, least: int, name: str) -> DataFrame:
    """``lang, phrase, size, f`` of the phrases of a level that occur ``least`` times (and the null one)."""
    held = None if table is None else chunks.sparkSession.sparkContext.broadcast(table)

    def make(rows: pa.Table) -> pa.RecordBatch:
        chunk, n = (rows.column(c).combine_chunks() for c in ("chunk", "n"))
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        langs, found, sizes, sums = [], [], [], []
        for code, y in enumerate(lang.dictionary.to_pylist()):
            at = np.flatnonzero(lang.indices.to_numpy() == code)
            s = Slice(y, chunk.take(pa.array(at)), n.to_numpy()[at])
            for phrase, size, f in level(s, held.value) if held else level(s):
                langs += [y] * len(f)
                sizes.append(np.full(len(f), size, np.int32))
                found.append(phrase)
                sums.append(f)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.concat_arrays(found), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums))],
            names=["lang", "phrase", "size", "f"])

    seen = chunks.mapInArrow(common.in_gathered_slices(make, "chunk"), "lang string, phrase string, size int, f bigint")
    whole = seen.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return common.stored(whole.where((F.col("f") >= least) | F.col("phrase").isNull()), name)


def bits_of(frequent: DataFrame) -> np.ndarray:
    def make(batches):
        for batch in batches:
            hashes, out = common.WordHashes(), []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                out.append(slots(lang, list(hashes.of(phrase.encode().split(b" "))[:, None])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.empty(0, np.uint64)]).astype(np.int64))], names=["slot"])

    named = frequent.where("phrase is not null").select("lang", "phrase")
    return common.bit_table(named.mapInArrow(make, "slot bigint"), BITS)


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of one to four words with at least ``least`` occurrences;
    the row with a null phrase tells how many words the language has."""
    common.ship(docs.sparkSession)
    parsed = common.stored(dictionary(docs), "chunks")
    single = counted(parsed, words, None, least, "words")
    double = counted(parsed, pairs, bits_of(single), least, "pairs")
    rest = counted(parsed, longer, bits_of(double), least, "longer")
    return single.unionByName(double).unionByName(rest)


def exact(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of all candidates."""
    candidates = counts.where("size > 1")
    cut = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    known = counts.where("phrase is not null")
    cut = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.withColumn("up", exact(exact(F.lit(SCALE)) * exact("a"))).withColumn("down", exact(exact("l") + exact("r")))
    cut = cut.withColumn("score", F.expr("up div down"))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return cut.groupBy("lang", "phrase", "size", "a").agg(weakest).select("lang", "phrase", "size", "a", "m.l", "m.r", "m.score")


def not_inside(candidates: DataFrame, within: int = WITHIN) -> DataFrame:
    """Without the candidates that lie in a longer one at least ``within`` percent as frequent."""
    wide = candidates.where("size > 2").select("lang", F.split("phrase", " ").alias("w"), "size", "a")
    wide = wide.select("*", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    wide = wide.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    part = wide.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a")
    most = part.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    inside = exact(exact("longer") * 100) >= exact(exact("a") * within)
    return joined.where(~F.coalesce(inside, F.lit(False))).drop("longer")


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; no task ranks more than about PART rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    turn = 0
    while (n := rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > max(PART, 2 * top):
        parts = -(-n // max(PART, 4 * top))
        turn += 1
        salted = rows.withColumn("_part", F.pmod(F.xxhash64("phrase", F.lit(turn)), F.lit(parts)))
        place = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        rows = common.stored(salted.withColumn("_place", place).where(F.col("_place") <= top).drop("_part", "_place"), f"first-{turn}")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``top`` phrases of each language."""
    counts = frequent(docs, least)
    kept = common.stored(not_inside(scored(counts)), "candidates")
    n = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    return first_of_each(kept, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
