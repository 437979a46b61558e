"""Token-id files: bit-plane shuffling by bytes, a zstandard frame for each plane, and a chunk index.

Layout of a file, all numbers little-endian unsigned:

- ``MAGIC``
- chunks: the ids of CHUNK_IDS ids (the last chunk has fewer), as 32-bit numbers turned into four byte planes (all
  lowest bytes, then all next ones, ...), each plane compressed on its own
- the table of documents: doc_id and number of ids of each, as 64-bit numbers in eight planes each, and whether the
  doc_id is null as one plane
- the chunk index: for each chunk its offset, its number of ids and the lengths of its four planes, 64 bits each
- footer: offset of the table of documents, number of documents, offset of the index, number of chunks, ``MAGIC``

A reader can go to any id through the index and reads one chunk at a time.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import new_folder, releasing, removed, text_or_empty, written
from tidelog.llm.units import UnitTable, ids_of_texts, parts_of, text_blocks

MAGIC = b"TIDEPLN1"
CHUNK_IDS = 1 << 16
_FOOTER = struct.Struct("<QQQQ8s")
_LEVEL = 3
_JOINED_UNITS = 4096
#: Marks that end a word; an apostrophe may begin a token with letters, so it is none.
_MARKS = ".,;:!?*#$%&|"
#: Bytes of text that are cut into units together.
_BLOCK_BYTES = 8 << 20


def _planes(values: np.ndarray) -> list[bytes]:
    """Each byte plane of values, compressed."""
    turned = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return [zstandard.ZstdCompressor(level=_LEVEL).compress(plane.tobytes()) for plane in turned]


def _values(planes: list[bytes], kind: str) -> np.ndarray:
    raw = [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8) for p in planes]
    return np.ascontiguousarray(np.stack(raw, axis=1)).view(kind).ravel()


class PlaneWriter:
    """Writes one file; holds one chunk of ids and the table of its documents."""

    def __init__(self, sink):
        self.sink, self.offset = sink, 0
        self.held: list[bytes] = []
        self.held_ids = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.index: list[tuple[int, ...]] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def _chunk(self, ids: np.ndarray) -> None:
        planes = _planes(ids)
        self.index.append((self.offset, len(ids), *map(len, planes)))
        for plane in planes:
            self._write(plane)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.held_ids >= CHUNK_IDS:
            joined = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(joined) // CHUNK_IDS * CHUNK_IDS
            for at in range(0, whole, CHUNK_IDS):
                self._chunk(joined[at : at + CHUNK_IDS])
            self.held, self.held_ids = [joined[whole:].tobytes()], len(joined) - whole

    def close(self) -> None:
        if self.held_ids:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        at_documents = self.offset
        if self.doc_ids:
            known = np.array([x or 0 for x in self.doc_ids], "<i8")
            planes = [*_planes(known), *_planes(np.array(self.counts, "<u8")), *_planes(np.array([x is None for x in self.doc_ids], np.uint8))]
            for plane in planes:
                self._write(struct.pack("<Q", len(plane)) + plane)
        at_index = self.offset
        self._write(np.array(self.index, "<u8").tobytes())
        self._write(_FOOTER.pack(at_documents, len(self.doc_ids), at_index, len(self.index), MAGIC))


class PlaneReader:
    """Reads one file from a source that can seek."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        at_documents, n_docs, at_index, n_chunks, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file, or one that was not finished")
        self.index = np.frombuffer(self._at(at_index, n_chunks * 48), "<u8").reshape(n_chunks, 6)
        planes, at = [], at_documents
        while at < at_index:
            (length,) = struct.unpack("<Q", self._at(at, 8))
            planes.append(self._at(at + 8, length))
            at += 8 + length
        null = _values(planes[16:], "u1") if n_docs else []
        self.doc_ids = [None if gone else x for x, gone in zip(_values(planes[:8], "<i8").tolist(), null, strict=True)] if n_docs else []
        self.counts = _values(planes[8:16], "<u8").tolist() if n_docs else []

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(int(offset))
        return self.source.read(int(length))

    def chunks(self) -> Iterator[np.ndarray]:
        for offset, n_ids, *lengths in self.index.tolist():
            data, planes = self._at(offset, sum(lengths)), []
            for length in lengths:
                planes.append(data[:length])
                data = data[length:]
            ids = _values(planes, "<u4")
            if len(ids) != n_ids:
                raise ValueError("a chunk does not have the ids that the index says")
            yield ids

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        chunks, rest = self.chunks(), np.empty(0, "<u4")
        for doc_id, count in zip(self.doc_ids, self.counts, strict=True):
            parts = [rest[:count]]
            have, rest = len(parts[0]), rest[count:]
            while have < count:
                chunk = next(chunks)
                parts.append(chunk[: count - have])
                have, rest = have + len(parts[-1]), chunk[count - have :]
            yield doc_id, b"".join(p.tobytes() for p in parts)


class UnitEncoder:
    """Encodes texts with the tokenizers library; ids of units of text that were seen before are looked up.

    New units of a block of texts go to the library joined, as many calls on single ones take longer; the lengths of
    the tokens, in bytes, lead each id back to its unit. What is kept is bounded
    (:class:`tidelog.llm.units.UnitTable`). That holds for byte-level BPE with its own pattern and without a normalizer;
    with any other tokenizer, all texts go to the library whole.

    With ``added_tokens``, as the library has it by itself, a text that holds one of the tokenizer's added tokens goes
    to the library whole, so that the token keeps its own id; else it is text as any other.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        by_bytes = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_units = made["normalizer"] is None and by_bytes.items() <= (made["pre_tokenizer"] or {}).items() and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        # Units hold no added token, but joined ones might by chance.
        self.tokenizer.encode_special_tokens = True
        # A byte-level vocabulary writes each byte as one character.
        self.lengths = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())])
        self.table = UnitTable(self._learn)

    def _learn(self, new: pa.Array, after_blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units; those of a word and closing marks are made of the two, which never merge."""
        if not after_blank:
            return self._each(new)
        words = pc.utf8_rtrim(new, _MARKS)
        made = pc.and_(pc.less(pc.binary_length(words), pc.binary_length(new)), pc.utf8_is_alpha(words))
        coded = pc.if_else(made, words, new).dictionary_encode()
        over = np.where(made.to_numpy(zero_copy_only=False), pc.binary_length(new).to_numpy() - pc.binary_length(words).to_numpy(), 0)
        ends = np.frombuffer(new.buffers()[1], np.int64)[new.offset + 1 :][: len(new)]
        tails = parts_of(np.frombuffer(new.buffers()[2], np.uint8), ends - over, over)
        marks = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(np.concatenate(([0], np.cumsum(over)))), pa.py_buffer(tails)).dictionary_encode()
        ids, counts = self._after_blanks(coded.dictionary)
        mark_ids, mark_counts = self._each(marks.dictionary)
        word, mark = coded.indices.to_numpy(), marks.indices.to_numpy()
        starts = np.stack(((np.cumsum(counts) - counts)[word], len(ids) + (np.cumsum(mark_counts) - mark_counts)[mark]), axis=1)
        lengths = np.stack((counts[word], mark_counts[mark]), axis=1)
        return parts_of(np.concatenate((ids, mark_ids)), starts.ravel(), lengths.ravel()), lengths.sum(axis=1)

    def _each(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(new.to_pylist(), add_special_tokens=False)]
        return np.array([k for ids in found for k in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _after_blanks(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units with a blank before them, many in one call."""
        parts, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(new), _JOINED_UNITS):
            part = new.slice(at, _JOINED_UNITS)
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part.to_pylist())], add_special_tokens=False)[0].ids, "<u4")
            unit_ends = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False) + 1)
            token_ends = np.cumsum(self.lengths[ids])
            places = np.searchsorted(token_ends, unit_ends)
            if places[-1] != len(ids) - 1 or not np.array_equal(token_ends[places], unit_ends):
                raise ValueError("the tokens of joined units do not end where the units do")
            parts.append(ids)
            counts.append(np.diff(places + 1, prepend=0))
        return np.concatenate(parts), np.concatenate(counts)

    def _encode_whole(self, texts: list[str], added: bool) -> list[bytes]:
        # A second tokenizer would take as much memory again.
        self.tokenizer.encode_special_tokens = not added
        try:
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        finally:
            self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_units:
            return self._encode_whole(texts.to_pylist(), bool(self.added))
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return ids_of_texts(*self.table.encode(texts))
        cut = iter(ids_of_texts(*self.table.encode(texts.filter(pa.array(~whole)))) if not whole.all() else [])
        uncut = iter(self._encode_whole(texts.filter(pa.array(whole)).to_pylist(), True))
        return [next(uncut if k else cut) for k in whole.tolist()]


@functools.cache
def _unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path, added_tokens=True)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes docs(doc_id, text) and writes the ids, with end_id after each document, in ascending doc_id order.

    Rows are dealt by ranges of doc_id, so shards are in order and each task writes one file of its own; a task that
    runs again writes another file, and only what the tasks that count have returned is in the result: one row a file,
    (shard, path, n_docs, n_ids, start), where start is the number of ids in the shards before.

    Ids are the library's with ``add_special_tokens=False`` and all else as it is: an added token that stands in a text has
    its own id. Null text counts as empty and gives the end id alone. Null doc_ids come first; rows of one doc_id are in the order
    of their texts. Other columns of docs are ignored. An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encoder, sink = struct.pack("<I", end_id), _unit_encoder(tokenizer_path), None
        store, root = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            if batch.num_rows and sink is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(path)
                writer = PlaneWriter(sink)
            ids = iter(batch.column(0).to_pylist())
            for block in text_blocks(batch.column(1), _BLOCK_BYTES):
                for tokens in encoder.encode(block):
                    writer.add(next(ids), tokens + end)
        if sink is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": len(writer.counts), "n_ids": writer.n_ids}])

    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = written(spark, ordered.mapInArrow(lambda batches: releasing(write(batches)), "shard long, path string, n_docs long, n_ids long"), "token-shards")
    # One row a file: as many as there were tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files that shards names; start counts ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)

        def rows(found: list) -> pa.RecordBatch:
            doc_ids, starts, counts, ids = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
            )

        for batch in batches:
            for shard in batch.to_pylist():
                with store.open_input_file(shard["path"]) as source:
                    at, found, size = shard["start"], [], 0
                    for doc_id, ids in PlaneReader(source).documents():
                        found.append((doc_id, at, len(ids) // 4, ids))
                        at += len(ids) // 4
                        size += len(ids)
                        if size > 8 << 20:
                            yield rows(found)
                            found, size = [], 0
                    if found:
                        yield rows(found)

    dealt = shards.repartition(max(1, shards.count()))
    return dealt.mapInArrow(lambda batches: releasing(read(batches)), "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes token-id files, reads them back and returns what they hold: doc_id, start, n_tokens, ids_crc32.

    Rows, order, nulls and repeats are as :func:`write_token_files` has them: a null or empty text has the end id alone,
    a text of any length is one document over as many chunks as it needs, and each of rows that repeat a doc_id has its
    own start. An empty table gives no rows. The files are removed when the digests are a table.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    shards = write_token_files(docs, tokenizer_path, end_id, folder)
    found = read_token_files(spark, shards, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found = written(spark, found, "token-digests")
    removed(spark, folder)
    return found
