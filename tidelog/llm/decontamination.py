"""Benchmark decontamination: size-partitioned MinHash containment search, verified on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import Scratch, releasing, text_or_empty
from tidelog.llm.shingles import blocks, shingle_set, shingler

#: Share of an item's distinct shingles that a document must have, in percent.
PERCENT = 75
#: Bits of a size class's filter for each value in its sketches, and the most bits as a power of two: 4 MB a class.
FILTER_BITS_PER_VALUE = 64
MOST_FILTER_BITS = 25
#: Bits in one bitmap of Spark's bitmap functions.
_BITMAP = 32768


def needed(n: int) -> int:
    """Shingles of a set of n that a document must have."""
    return math.ceil(PERCENT * n / 100)


def size_class(n: int) -> int:
    """The p of the class of a set of n: sets of 2^(p-1) to 2^p - 1 shingles."""
    return n.bit_length()


def sketch_size(p: int) -> int:
    """How many of the smallest hashes make the sketch of a set in class p.

    Of the largest set of the class, of u shingles, at most ``u - needed(u)`` may be missing from a document, so of one
    value more at least one is among the document's hashes, for every set of the class.
    """
    largest = 2**p - 1
    return largest - needed(largest) + 1


def item_sketch(text: bytes) -> tuple[int, int, np.ndarray, int]:
    """(size of the set, its class, sketch, how many values of the sketch a document with enough of the set has)."""
    own = np.unique(np.concatenate(shingler().hashes([text])))
    n = len(own)
    sketch = own[: sketch_size(size_class(n))]
    return n, size_class(n), sketch, len(sketch) - (n - needed(n))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) of each item's text, with what :func:`item_sketch` has of it."""
    for batch in batches:
        made = [item_sketch(t.as_buffer().to_pybytes()) for t in batch.column(1)]
        columns = [pa.array([m[k] for m in made], kind) for k, kind in ((1, pa.int32()), (3, pa.int32()))]
        sketches = pa.array([m[2].view(np.int64) for m in made], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, sketches], ["item", "text", "p", "least", "sketch"])


class ClassFilter:
    """A bit table of the sketch values of one class, by two slots a value; a value of a sketch is always in it."""

    def __init__(self, p: int, bits: int, bitmaps: list[tuple[int, bytes]]):
        self.bits, self.fewest = bits, needed(2 ** (p - 1))
        self.table = np.zeros(2**bits // 8, np.uint8)
        for number, bitmap in bitmaps:
            self.table[number * _BITMAP // 8 :][: len(bitmap)] = np.frombuffer(bitmap, np.uint8)

    def _set(self, slots: np.ndarray) -> np.ndarray:
        return (self.table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def passed(self, places: np.ndarray) -> np.ndarray:
        """The distinct hashes that may be in a sketch; none of a document too small for the class."""
        if len(places) < self.fewest:
            return places[:0]
        maybe = places[self._set(places >> np.uint64(64 - self.bits))]
        return np.unique(maybe[self._set(maybe & np.uint64(2**self.bits - 1))]) if len(maybe) else maybe


def _filters(values: DataFrame) -> dict[int, ClassFilter]:
    """The filter of each class of values(p, value); counted and set in tasks, at most 4 MB a class come back."""
    counts = {r["p"]: r["n"] for r in values.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    bits = {p: min(MOST_FILTER_BITS, max(_BITMAP.bit_length() - 1, (FILTER_BITS_PER_VALUE * n).bit_length())) for p, n in counts.items()}
    of_class = F.element_at(F.create_map(*(F.lit(x) for pair in bits.items() for x in pair)), F.col("p"))
    slots = values.withColumn("bits", of_class).select("p", F.expr("explode(array(shiftrightunsigned(value, 64 - bits), value & (shiftleft(1L, bits) - 1))) as slot"))
    maps = slots.groupBy("p", F.floor(F.col("slot") / _BITMAP).alias("number")).agg(F.bitmap_construct_agg(F.col("slot") % _BITMAP).alias("bitmap")).collect()
    return {p: ClassFilter(p, bits[p], [(r["number"], r["bitmap"]) for r in maps if r["p"] == p]) for p in sorted(counts)}


def _hits(batches: Iterator[pa.RecordBatch], filters: Broadcast) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, p, value) of the hashes of each row's shingles that may be in a sketch of class p."""
    for batch in batches:
        row, owners, classes, values = 0, [], [], []
        for texts in blocks(batch.column(2)):
            for places in shingler().hashes(texts):
                for p, own in filters.value.items():
                    if len(found := own.passed(places)):
                        owners.append(np.full(len(found), row))
                        classes.append(np.full(len(found), p, np.int32))
                        values.append(found)
                row += 1
        if values:
            at = pa.array(np.concatenate(owners))
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(classes)), pa.array(np.concatenate(values).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "p", "value"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (doc_id, text, item, item_text) whose document has enough of the item, by the shingles themselves."""
    for batch in batches:
        last, full, rows, sizes, overlaps = None, set(), [], [], []
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            if text != last:  # a document's pairs mostly stand together
                last, full = text, shingle_set(text)
            wanted = shingle_set(batch.column(3)[k].as_py())
            if (shared := len(wanted & full)) >= needed(len(wanted)):
                rows.append(k)
                sizes.append(len(wanted))
                overlaps.append(shared)
        at = pa.array(rows, pa.int64())
        containment = pa.array([s / n for n, s in zip(sizes, overlaps, strict=True)], pa.float64())
        columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(sizes, pa.int64()), pa.array(overlaps, pa.int64()), containment]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item", "n_item", "n_shared", "containment"])


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for each row of docs(doc_id, text) that has an item's text.

    A document has an item of items(item_id, text) when at least 75 % of the item's distinct five-word shingles (A-Z
    in lower case, white space between words) are among its own, wherever they stand.

    Distinct item texts are sketched in tasks, by classes of the size of their sets (:func:`sketch_size`), so that the
    search passes over no document that has enough of an item. A document is searched for the classes that it is large
    enough for: the hashes of its shingles that pass the class's filter, which is of bounded size, are joined with
    the sketches by class and value, and what has as many values of an item's sketch as it must is a candidate.
    Candidates are confirmed on the shingles of the full texts. Texts of documents are shuffled only where there are
    too many candidates for Spark to broadcast.

    Null and empty texts have nothing and are nowhere. An item of fewer than five words is one shingle and is found in
    documents of just these words. Each pair of rows is one row of the result, so rows that repeat an item's id or a
    document's repeat in it. Null ids are carried along. Other columns are ignored. Without documents or items the
    result is empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text"))
    numbered = queries.select("text").distinct().select(F.monotonically_increasing_id().alias("item"), "text")
    known = scratch.written(numbered.mapInArrow(lambda batches: releasing(_sketched(batches)), "item long, text string, p int, least int, sketch array<long>"), "items")
    # Written, so that Spark knows their true size when it chooses how to join them.
    values = scratch.written(known.select("item", "p", "least", F.explode("sketch").alias("value")), "values")
    names = scratch.written(queries.join(known.select("item", "text"), "text").select("item", "item_id"), "names")
    filters = spark.sparkContext.broadcast(_filters(values))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hits = rows.mapInArrow(lambda batches: releasing(_hits(batches, filters)), "doc_id long, text_hash long, p int, value long")
    counted = hits.join(values, ["p", "value"]).groupBy("doc_id", "text_hash", "item", "least").agg(F.count(F.lit(1)).alias("n"))
    candidates = counted.filter("n >= least").select(F.col("doc_id").alias("own"), F.col("text_hash").alias("own_hash"), "item")
    candidates = scratch.written(candidates, "candidates")
    pairs = rows.join(candidates, (F.col("text_hash") == F.col("own_hash")) & F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", "text", "item")
    texts = known.select("item", F.col("text").alias("item_text"))
    confirmed = pairs.join(texts, "item").select("doc_id", "text", "item", "item_text")
    found = confirmed.mapInArrow(lambda batches: releasing(_verified(batches)), "doc_id long, item long, n_item long, n_shared long, containment double")
    return found.join(names, "item").select("doc_id", "item_id", "n_item", "n_shared", "containment")
