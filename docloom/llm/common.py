"""Helpers that the operators share: tables, filters of bounded size, and what the library has for all its operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.graph import components, spread_join
from docloom.sources.written import discard, materialize

__all__ = ["LOWER_AZ", "components", "discard", "filter_of", "in_slots", "materialize", "sieve", "slot_bits", "slot_filter", "slot_rows", "spread_join", "table", "without"]

#: For bytes.translate: A-Z become a-z, every other byte stays.
LOWER_AZ = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a filter that goes to every task (8 MB), at most; below that 16 for every key in it.
FILTER_BITS = 1 << 26

def filter_size(n: int) -> int:
    return min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))


def filter_of(keys: DataFrame, hashed: Column, size: int) -> DataFrame:
    """(b, bits): the set bits of a filter of `size` bits over the hashes, in rows of 4 KB. It may say yes to other keys,
    never no to one of these; where its size reaches FILTER_BITS it says yes more often."""
    slot = keys.select((F.pmod(hashed, F.lit(size)) + 1).alias("s"))
    return slot.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))


def sieve(docs: DataFrame, gone: DataFrame, keys: list[Column], names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(passed, stopped): the rows of docs in two parts. A row whose keys are those of a row of gone (columns `names`;
    written, without nulls) is in `stopped`, with some others; `passed` has the rest, where it lies. The filter is made
    from gone and of bounded size."""
    hashed, size = F.xxhash64(*keys), filter_size(gone.count())
    bits = F.broadcast(materialize(filter_of(gone, F.xxhash64(*names), size)).withColumnsRenamed({"b": "__b", "bits": "__bits"}))
    slot = F.pmod(hashed, F.lit(size))
    byte = F.conv(F.hex(F.substring("__bits", ((slot % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = docs.join(bits, (slot / 32768).cast("long") + 1 == F.col("__b"), "left")
    stopped = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (slot % 8 + 1).cast("int"))) != 0, F.lit(False))
    return asked.where(~stopped).select(docs.columns), asked.where(stopped).select(docs.columns)


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
    """The rows of docs whose keys are not those of a row of gone (columns `names`; written, without nulls).

    A filter of bounded size, made from gone, lets most rows pass where they lie; only the rows it stops, those that go
    and some others, cross a shuffle to a merge join. One plan at every size. Rows with a null key stay.
    """
    passed, stopped = sieve(docs, gone, keys, names)
    sent = gone.select(*(F.col(n).alias(f"__{n}") for n in names)).hint("merge")
    same = [k == F.col(f"__{n}") for k, n in zip(keys, names)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return passed.union(stopped.join(sent, on, "left_anti"))


#: Slots of a filter that counts hashes, the same at every size, so what goes to a task is 32 MB of bits at most; slots of a row.
SLOTS, SLOTS_IN_ROW = 1 << 28, 1 << 20
SLOT_ROWS = "block int, slots binary, n binary"


def slot_rows(hashes: np.ndarray, most: int) -> pa.RecordBatch:
    """The slots of some hashes as rows (block, slots, n): each slot once, with its number of hashes up to `most`."""
    slots, n = np.unique((hashes & np.uint64(SLOTS - 1)).astype(np.uint32), return_counts=True)
    n = np.minimum(n, most).astype(np.uint8)
    blocks, at = np.unique(slots // SLOTS_IN_ROW, return_index=True)
    ends = [*at[1:], len(slots)]
    inside = (slots % SLOTS_IN_ROW).astype(np.uint32)
    cols = [pa.array(blocks.astype(np.int32)), pa.array([inside[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["block", "slots", "n"])


def slot_filter(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], test: Callable[[np.ndarray], np.ndarray]):
    """A broadcast filter from slot_rows(): `add(state, slots, n)` takes a row into the bytes of its block, `test(state)`
    says which slots are in the filter. A task holds one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = np.zeros(SLOTS_IN_ROW, np.uint8), None
        full = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(np.packbits(test(state), bitorder="little").tobytes(), 1)])], names=["block", "bits"])
        for b in batches:
            for block, slots, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if block != at:
                    if at is not None:
                        yield full()
                    at, state[:] = block, 0
                add(state, np.frombuffer(slots.as_py(), np.uint32), np.frombuffer(n.as_py(), np.uint8))
        if at is not None:
            yield full()

    parts = rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary").collect()
    return rows.sparkSession.sparkContext.broadcast({r["block"]: bytes(r["bits"]) for r in parts})


def slot_bits(parts: dict[int, bytes]) -> np.ndarray:
    """The bits of a slot_filter(), in a task."""
    bits = np.zeros(SLOTS // 8, np.uint8)
    for block, part in parts.items():
        bits[block * (SLOTS_IN_ROW // 8) : (block + 1) * (SLOTS_IN_ROW // 8)] = np.frombuffer(zlib.decompress(part), np.uint8)
    return bits


def in_slots(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = hashes & np.uint64(SLOTS - 1)
    return (bits[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1
