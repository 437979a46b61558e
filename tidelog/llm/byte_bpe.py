"""Byte-level BPE: encoding by corpus-level merge replay, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import releasing, text_or_empty
from tidelog.llm.units import BYTE_LEVEL_PATTERN, UnitTable, ids_of_texts, text_blocks

#: Bytes of new words that are replayed together.
REPLAY_BYTES = 2 << 20
#: Bytes of text that are cut into units together.
BLOCK_BYTES = 8 << 20
_NONE = np.uint32(0xFFFFFFFF)


class MergeReplay:
    """Encodes words by replaying the merges of a rank table over all of them at once.

    All words lie in one array of symbols with links to their neighbours. The inverted index leads from a merge (the
    pairs of tokens that give the token of one rank) to the positions in words where such a pair stands. Merges are
    taken in rank order; each touches the positions listed for it and enters the pairs that its neighbours then form.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.zeros(256, np.int32)
        for byte in range(256):
            self.single[byte] = ranks[bytes([byte])]
        pairs: dict[int, int] = {}
        backward: set[int] = set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
                    backward |= {part for part in (left, right) if part > rank}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.uint32)
        #: Tokens that may, once made, enter a merge of a lower rank: these are made one place in a word at a time.
        self.backward = backward

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers; words aren't empty."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        # 32 bits are enough for positions in REPLAY_BYTES; a longer word goes alone, with 64 bits where it needs them.
        kind = np.int32 if n < 2**31 - 1 else np.int64
        symbol = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=kind), lengths)
        following, before = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
        following[ends - 1] = -1
        before[ends - lengths] = -1
        alive = np.ones(n, bool)
        rank_at = np.full(n, _NONE, np.uint32)
        inner = np.flatnonzero(following >= 0)
        rank_at[inner] = self._ranks_of(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            found = rank_at[places]
            places, found = places[found != _NONE], found[found != _NONE]
            if not len(places):
                return
            by = np.argsort(found, kind="stable")
            places, found = places[by], found[by]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for rank, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts) if len(cuts) else [places], strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        enter(inner)
        while heap:
            rank = heapq.heappop(heap)
            listed = index.pop(rank)
            at = listed[0] if len(listed) == 1 else np.concatenate(listed)
            at = at[rank_at[at] == rank]
            if len(listed) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            if rank in self.backward:
                first = np.ones(len(at), bool)
                first[1:] = word[at[1:]] != word[at[:-1]]
                rest, at = at[~first], at[first]
                if len(rest):
                    index[rank] = [rest]
                    heapq.heappush(heap, rank)
            elif len(at) > 1:
                # Where one place's right token is the next place's left one, every other place of the run merges.
                chained = np.zeros(len(at), bool)
                chained[1:] = following[at[:-1]] == at[1:]
                if chained.any():
                    step = np.arange(len(at))
                    at = at[(step - np.maximum.accumulate(np.where(chained, 0, step))) % 2 == 0]
            right = following[at]
            after = following[right]
            symbol[at] = rank
            following[at] = after
            alive[right] = False
            rank_at[right] = _NONE
            rank_at[at] = _NONE
            has_after = after >= 0
            before[after[has_after]] = at[has_after]
            left = before[at]
            touched = np.concatenate((left[left >= 0], at[has_after]))
            rank_at[touched] = self._ranks_of(symbol[touched], symbol[following[touched]])
            enter(touched)
        kept = np.flatnonzero(alive)
        ids = symbol[kept].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(word[kept], minlength=len(words)))).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]


@functools.cache
def _tables(path: str) -> MergeReplay:
    with open(path, "rb") as file:
        return MergeReplay({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})


class Encoder:
    """Encodes and decodes texts in one worker.

    With the pattern of byte-level BPE, texts are cut into units whose ids are kept in a table of bounded size
    (:class:`tidelog.llm.units.UnitTable`); with another pattern each text is one unit, and none is kept.
    """

    def __init__(self, ranks_path: str, pattern: str):
        self.replay = _tables(ranks_path)
        self.matches = regex.compile(pattern).findall
        self.table = UnitTable(self._learn) if pattern == BYTE_LEVEL_PATTERN else None
        self.lengths = np.fromiter(map(len, self.replay.tokens), np.int64, self.replay.size)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(self.replay.tokens), np.uint8)

    def _learn(self, new: pa.Array, after_blank: bool) -> tuple[np.ndarray, np.ndarray]:
        found = self._replayed([" " + unit for unit in new.to_pylist()] if after_blank else new.to_pylist())
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _replayed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, of a block's distinct words at a time."""
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (size < REPLAY_BYTES or stop == at):
                size += len(texts[stop])
                stop += 1
            parts = [self.matches(text) for text in texts[at:stop]]
            words = list({w for part in parts for w in part})
            ids = dict(zip(words, self.replay.encode([w.encode() for w in words]), strict=True))
            out += [b"".join(map(ids.__getitem__, part)) for part in parts]
            at = stop
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return ids_of_texts(*self.table.encode(texts)) if self.table is not None else self._replayed(texts.to_pylist())

    def decode(self, ids: bytes) -> bytes:
        x = np.frombuffer(ids, "<u4")
        lengths = self.lengths[x]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[x] - (ends - lengths), lengths)
        return self.flat[np.arange(len(shift)) + shift].tobytes()


@functools.cache
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], own: Encoder) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Blocks of the batches' first column with the ids of their texts."""
    for batch in batches:
        done = 0
        for block in text_blocks(batch.column(1), BLOCK_BYTES):
            ids = own.encode(block)
            yield batch.column(0).slice(done, len(block)), ids
            done += len(block)


def bpe_tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, ids (little-endian unsigned 32-bit integers), decoded bytes.

    Every text is encoded whole: each match of the pattern on its own, by the ranks in the file, without special
    tokens. A task gathers the distinct words of a block of its rows and replays the merges over all of them
    (:class:`MergeReplay`); no shuffle is needed, as words don't depend on each other, and what a worker keeps is
    bounded (:class:`tidelog.llm.units.UnitTable`). decoded is made from the ids alone.

    Null text counts as empty: no ids, no bytes. Row order, repeated rows and null ids don't matter. Other columns of
    docs are ignored. The rank file must be readable at its path on every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for doc_ids, ids in _encoded(batches, own):
            part = [doc_ids, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(part, ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(lambda batches: releasing(encode(batches)), f"doc_id {kind}, ids binary, decoded binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """:func:`bpe_tokens` as doc_id, n_tokens, ids_sha256, decoded_sha256, hashed where the ids are made."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for doc_ids, ids in _encoded(batches, own):
            part = [
                doc_ids,
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids]),
            ]
            yield pa.RecordBatch.from_arrays(part, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lambda batches: releasing(digest(batches)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
