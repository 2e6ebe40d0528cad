"""SentencePiece encoding and decoding through a table of distinct marked words.

The whitespace marker U+2581 (which also stands for a blank) never follows another character inside
a piece of such a model, so no merge crosses the place before a run of markers: a text's ids are
those of its marked words, one after the other.  Each slice of texts is cut into marked words, every
distinct one is segmented and decoded once by the sentencepiece library, and ids and surfaces are
joined back by position.  ``check_model`` refuses a model whose pieces or normaliser break this.

Work is done where the texts are: nothing is shuffled, and the table lives per task and is emptied
when it is full.

Defined results: a null text is an empty one (only begin and end ids, decoded to ""); blanks at
either end, runs of blanks and literal markers are kept as the library keeps them; other columns of
any name pass through, except that ``ids``, ``n_tokens`` and ``decoded`` are replaced; repeated rows
are encoded each; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tempora.llm import common

MARKED_WORD = re.compile("[ ▁]+[^ ▁]*")
PROBES = ("a b", " a", "a  b   c ", "▁a ▁b", "\n a\nb", "x\t\ty", "ｆ  ", "a ▁ ")


@lru_cache(maxsize=2)
def processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def check_model(model_file: str) -> None:
    """Raise unless pieces stay within marked words and nothing but the dummy prefix is added."""
    p = processor(model_file)
    crossing = [s for i in range(p.get_piece_size()) if "▁" in (s := p.id_to_piece(i)).lstrip("▁")]
    if crossing:
        raise ValueError(f"pieces cross whitespace markers: {crossing[:3]}")
    words = MarkedWords(model_file)
    for probe in PROBES:
        ids, text = words.of(probe)
        if np.frombuffer(ids, "<u4").tolist() != p.encode(probe) or text != p.decode(p.encode(probe)):
            raise ValueError(f"the model's normaliser changes blanks: {probe!r}")


class MarkedWords:
    """The table: marked word -> (ids as little-endian 32-bit integers, surface)."""

    def __init__(self, model_file: str):
        self.p = processor(model_file)
        self.entry: dict[str, tuple[bytes, str]] = {" ": self._pack([self.p.piece_to_id("▁")])}

    def _pack(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " " + self.p.decode(ids)

    def add(self, words: set[str]) -> None:
        if len(self.entry) > common.CACHED_WORDS:
            self.entry = {" ": self.entry[" "]}
        new = [w for w in words if w not in self.entry]
        # the library itself puts a marker before what it encodes: the first of the run
        for word, ids in zip(new, self.p.encode([w[1:] for w in new]), strict=True):
            self.entry[word] = self._pack(ids) if len(word) > 1 else self._pack([self.p.piece_to_id("▁")])

    def of(self, text: str) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        words = MARKED_WORD.findall(" " + text)
        self.add(set(words))
        return self.join(words)

    def join(self, words: list[str]) -> tuple[bytes, str]:
        found = [self.entry[w] for w in words]
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])[1:]


def encode(docs: DataFrame, model_file: str, text: str = "text", packed: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (begin and end ids included), ``n_tokens`` and ``decoded``.

    ``ids`` is array<int>, or with ``packed`` a binary of little-endian 32-bit integers.
    """
    common.ship(docs.sparkSession)
    check_model(model_file)
    made = ("ids", "n_tokens", "decoded")
    kept = [c for c in docs.columns if c not in made]
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    fields = [T.StructField("ids", kind), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])
    state: dict[str, MarkedWords] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = state.setdefault("table", MarkedWords(model_file))
        begin, end = (np.array([i], "<u4").tobytes() for i in (table.p.bos_id(), table.p.eos_id()))
        cut = [MARKED_WORD.findall(" " + t) if t else [] for t in batch.column("text").to_pylist()]
        table.add({w for words in cut for w in words})
        both = [table.join(words) for words in cut]
        ids = [begin + b + end for b, _ in both]
        if packed:
            column = pa.array(ids, pa.binary())
        else:
            column = common.lists([np.frombuffer(b, "<i4") for b in ids], pa.int32())
        arrays = [batch.column(i) for i in range(len(kept))]
        arrays += [column, pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([s for _, s in both], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=[*(f"c{i}" for i in range(len(kept))), *made])

    # columns travel under names of their own, so that none clashes with what is made here
    source = docs.select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)), docs[f"`{text}`"].alias("text"))
    inner = T.StructType([*(T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields[:len(kept)])), *fields])
    return source.mapInArrow(common.in_slices(one), inner).toDF(*schema.fieldNames())


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the library's decode of array<int> ``ids`` (null ids: null)."""
    common.ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != "decoded"]
    fields = [T.StructField(f"c{i}", encoded.schema[c].dataType, True) for i, c in enumerate(kept)]

    def run(batches):
        p = processor(model_file)
        for batch in batches:
            texts = [None if x is None else p.decode(x) for x in batch.column(f"c{kept.index(ids)}").to_pylist()]
            arrays = [batch.column(i) for i in range(len(kept))] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in fields), "decoded"])

    source = encoded.select(*(encoded[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)))
    return source.mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.StringType())])).toDF(*kept, "decoded")
