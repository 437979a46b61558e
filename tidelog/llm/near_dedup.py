"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, exact Jaccard, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components
from tidelog.llm.shared import Scratch, releasing, text_or_empty
from tidelog.llm.shingles import BLOCK_BYTES, blocks, shingler

#: Smallest hash values kept of a document.
SKETCH = 64
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Values that the sketches of two linked documents share at least. Of the 64 smallest values of the union each is
#: shared with a chance of 0.75 or more; fewer than 27 shared ones are over six standard deviations away.
SHARED = 27
#: Up to this size of a set, both sets of a link are whole in their sketches, and shares are exact.
WHOLE = SKETCH * PERCENT // 100
#: Documents drawn from its lists that a document is compared with first. They only save comparisons: pairs that the
#: links found so leave apart are all compared.
HEADS = 8


def document_sketches(docs: DataFrame, most: int | None = SKETCH) -> DataFrame:
    """(doc_id, n, key, sketch): size of the shingle set, SHA-256 of the words in order, the ``most`` smallest hashes in order.

    Texts of fewer words than a shingle has are linked with texts of the same words only, so their sketches are empty.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in blocks(batch.column(1)):
                block, sizes, sketches = shingler().block(texts), [], []
                for k in range(len(block)):
                    own = np.unique(block.places(k).view(np.int64))
                    sizes.append(len(own))
                    sketches.append(own[:most] if block.lasts[k] - block.firsts[k] >= block.size else own[:0])
                keys = [hashlib.sha256(block.words(k)).digest() for k in range(len(block))]
                part = batch.column(0).slice(done, len(block))
                done += len(block)
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sketches)]).astype(np.int32), np.concatenate(sketches))
                yield pa.RecordBatch.from_arrays([part, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n", "key", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(lambda batches: releasing(sketch(batches)), "doc_id long, n long, key binary, sketch array<long>")


def _least_shared(n: Column, of_larger: bool, whole: bool) -> Column:
    """Values that a sketch (or a whole set) of n shares with that of any linked set, or of any that is not smaller."""
    exact = F.ceil(n * PERCENT / F.lit(100)) if of_larger else F.ceil(n * (2 * PERCENT) / F.lit(100 + PERCENT))
    return exact if whole else F.when(n <= WHOLE, exact).otherwise(SHARED)


def _postings(sketches: DataFrame, whole: bool = False) -> DataFrame:
    """(value, id, n, at, first): the part of each sketch (of each set, if they are whole) that a linked document must also have, in lists of two or more.

    The values of a sketch are ordered by the number of documents with them, rarest first; a linked document shares
    at least s of them, so it has one of the first size - s + 1 (prefix filter). Values of one document only come
    first and are in no list, so a document that shares fewer than s values is in none. ``at`` is a value's place in this
    order, ``first`` marks the shorter prefix that is enough for the smaller one of two sets. As the frequent values stand
    last, a common passage puts a document in a list only if it makes up most of the document.
    """
    # Two texts may have one id, so the text's own number goes with it.
    values = sketches.select("id", "own_key", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = values.join(shared, "value").groupBy("id", "own_key", "n", "size").agg(F.sort_array(F.collect_set(F.struct("df", "value"))).alias("own"))
    alone = F.col("size") - F.size("own")
    probe = F.col("size") - _least_shared(F.col("n"), True, whole) + 1 - alone
    index = F.col("size") - _least_shared(F.col("n"), False, whole) + 1 - alone
    # A set of up to WHOLE words is whole in its sketch; a larger one is cut to SKETCH values.
    prefix = own.select("id", "n", alone.alias("alone"), probe.cast("int").alias("probe"), index.cast("int").alias("index"), "own").filter("probe > 0")
    listed = prefix.select("id", "n", "alone", "index", F.posexplode(F.slice("own", F.lit(1), F.col("probe"))).alias("at", "x"))
    return listed.select(F.col("x.value").alias("value"), "id", "n", (F.col("alone") + F.col("at")).alias("at"), (F.col("at") < F.col("index")).alias("first"))


def _runs(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows (a, b, text_a, text_b) of about BLOCK_BYTES of text, at least one row each."""
    run: list[tuple] = []
    size = 0
    for row in rows:
        run.append(row)
        size += len(row[2]) + len(row[3])
        if size > BLOCK_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(a, b) whose texts are linked, by their full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(column.to_pylist() for column in batch.columns), strict=True)
            for run in _runs(rows):
                block, found = shingler().block([t.encode() for row in run for t in row[2:]]), []
                for k, (one, other, *_) in enumerate(run):
                    x, y, common = block.shared(2 * k, 2 * k + 1)
                    if 100 * common >= PERCENT * (x + y - common):
                        found.append((one, other))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    ready = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return ready.mapInArrow(lambda batches: releasing(compare(batches)), "a long, b long")


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs(a, b) whose Jaccard similarity reaches PERCENT: estimated on sketches, then counted on the full sets."""
    side = sketches.select("id", "n", "sketch")
    both = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b")
    union = F.sort_array(F.array_union("s_a", "s_b"))
    bottom = F.slice(union, 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), bottom))
    whole = (F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH)
    exact = F.size(F.array_intersect("s_a", "s_b")) * 100 >= F.size(union) * PERCENT
    likely = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT) & F.when(whole, exact).otherwise(shared >= SHARED)
    pairs = scratch.written(both.filter(likely).select("a", "b").distinct(), "pairs")
    return scratch.written(_compared(pairs, texts), "links")


def _first_pairs(listed: DataFrame) -> DataFrame:
    """(a, b): each document with the smallest one in its lists, and with up to HEADS of those that the lists have drawn."""
    # A document is in as many lists as its sketch has values at most.
    met = listed.groupBy("id").agg(F.min("head").alias("head"), F.collect_set("drawn").alias("drawn"))
    drawn = F.array_sort(F.transform("drawn", lambda x: F.struct(F.xxhash64(x, F.col("id")).alias("h"), x.alias("id"))))
    some = F.concat(F.array("head"), F.transform(F.slice(drawn, 1, HEADS), lambda x: x["id"]))
    pairs = met.select("id", F.explode(F.array_distinct(some)).alias("other")).filter("id <> other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _open(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of lists whose documents are in more than one component."""
    mixed = rows.groupBy("value").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("value")
    return scratch.written(rows.join(scratch.written(mixed, "mixed"), "value"), "open")


def _apart(rows: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of documents of different components that can still be linked, of those in rows.

    Whole sets of these documents take the place of their sketches: inverted lists of all their values, cut by the
    prefix filter for the exact bound. A document with too many values that no other one has is in none of them. In each
    list, the documents outside the list's largest component are held against all others. Of the values that two
    documents share, the rarest stands at a place in the order of each: what stands before it is in one of the two only,
    so with too much before it they can't be linked (positional filter for the sizes of the pair). That keeps apart what
    has only a group's common text in common, as the differences of its members stand before that.
    """
    parts = scratch.written(rows.select("id", "part").distinct(), "parts")
    left = texts.join(parts, "id", "left_semi").select(F.col("id").alias("doc_id"), "text")
    sets = document_sketches(left, None).select(F.col("doc_id").alias("id"), F.xxhash64("key").alias("own_key"), "n", "sketch")
    sets = scratch.written(sets, "sets")
    listed = _open(scratch.written(_postings(sets, True).join(parts, "id"), "named"), scratch)
    largest = listed.groupBy("value", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("value").agg(F.max_by("part", F.struct("n", "part")).alias("most"))
    listed = scratch.written(listed.join(scratch.written(largest, "largest"), "value").withColumn("few", F.col("part") != F.col("most")).drop("most"), "sided")
    x, y = (listed.select("value", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "at", "part", "few"))) for s in "xy")
    both = F.col("n_x") + F.col("n_y")
    # The smallest intersection of linked sets of these sizes, in whole numbers.
    least = F.floor((both * PERCENT + (PERCENT + 99)) / F.lit(PERCENT + 100)).cast("long")
    may = (F.col("part_x") != F.col("part_y")) & (~F.col("few_y") | (F.col("id_x") < F.col("id_y")))
    may &= F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * PERCENT
    may &= (F.col("n_x") - F.col("at_x") >= least) & (F.col("n_y") - F.col("at_y") >= least)
    pairs = x.filter("few_x").join(y, "value").filter(may)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= 75 * union of their sets of five-word shingles (A-Z in lower
    case, white space between words; fewer words are one shingle). component_id is the smallest doc_id that links
    reach; kept says that it is the row's own.

    1. One pass over the texts gives each document the size of its set, the SHA-256 of its words in order and the 64
       smallest values of one hash function. Documents of the same words are one class; only a class's smallest doc_id
       goes on.
    2. Inverted lists of the retained values, cut by the prefix filter (:func:`_postings`).
    3. Each document is compared with the smallest one in its lists and with a few drawn ones, one drawn by each list;
       components of these links. A group of near copies, whose members are not all linked with each other, comes
       together at a few comparisons a member, not at one a pair.
    4. Documents that still share a list with another component get lists of their whole sets, and the pairs of these
       that share no component and pass the filters are compared (:func:`_apart`): all that may be linked is either
       compared or already in one component, so no link between components is lost.
    5. Sketches of the union estimate the similarity; pairs that may reach it are counted on their full sets, word for
       word (:meth:`tidelog.llm.shingles.Block.shared`).

    Null and empty texts have no shingles and are linked with nothing. Rows of one doc_id count as one document with
    the links of each. Rows with a null doc_id are linked with nothing and kept; their component_id is null. Other
    columns of docs are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    every = scratch.written(document_sketches(docs), "sketches")
    keyed = every.filter("doc_id is not null and n > 0")
    classes = scratch.written(keyed.groupBy("key").agg(F.min("doc_id").alias("id")), "classes")
    members = scratch.written(keyed.select("doc_id", "n", "key").join(classes, "key").select("doc_id", "n", "id"), "members")
    own = keyed.filter(F.size("sketch") > 0).withColumnRenamed("key", "text_key").join(classes, (F.col("text_key") == F.col("key")) & (F.col("doc_id") == F.col("id")))
    sketches = scratch.written(own.select("id", F.xxhash64("key").alias("own_key"), "n", "sketch"), "firsts")

    postings = scratch.written(_postings(sketches), "postings")
    drawn = F.min_by("id", F.xxhash64("id", "value")).alias("drawn")
    lists = postings.groupBy("value").agg(F.min(F.when(F.col("first"), F.col("id"))).alias("head"), drawn, F.min("id").alias("low"), F.max("id").alias("high"))
    lists = scratch.written(lists.filter("head is not null and low < high").select("value", "head", "drawn"), "lists")
    listed = scratch.written(postings.join(lists, "value"), "listed")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty("text").alias("text")).join(listed.select("id").distinct(), "id", "left_semi")
    texts = scratch.written(texts, "texts")
    scratch.keep("sketches", "members", "firsts", "listed", "texts")

    # A doc_id that several rows share may belong to several classes.
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    same = members.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b")).filter("a < b").distinct()
    links = scratch.written(same, "same").union(_verified(_first_pairs(listed), sketches, texts, scratch))
    parts = connected_components(links).toDF("id", "part")

    rows = listed.join(parts, "id", "left").select("value", "id", "n", "at", "first", F.coalesce("part", "id").alias("part"))
    rows = _open(scratch.written(rows, "parted"), scratch)
    # Of the links between components only the components are left: their smallest nodes stand for them.
    apart = _verified(_apart(rows, texts, scratch), sketches, texts, scratch)
    for end in "ab":
        apart = apart.join(parts.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    found = connected_components(scratch.written(apart, "between"))
    scratch.keep("sketches", "members")

    part = F.coalesce("part", "id").alias("part")
    result = members.join(parts, "id", "left").select("doc_id", "n", part).join(found.withColumnRenamed("node", "part"), "part", "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "part").alias("component_id"))
    result = result.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    alone = every.filter("doc_id is null or n = 0")
    alone = alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return result.union(alone)
