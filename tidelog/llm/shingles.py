"""Words and word shingles of whole texts as 64-bit hashes, for many texts at a time."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE_WORDS = 5
#: Bytes of text that are hashed together; a longer text goes alone.
BLOCK_BYTES = 1 << 19
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = bytes(32 if x in b"\x20\x09\x0a\x0b\x0c\x0d" else x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Odd multipliers, from a fixed seed, so that every run and worker hashes alike.
_ODD = np.random.default_rng(20240501).integers(0, 2**63, 2 + SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_ODD[0])
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes of a word up to which a polynomial modulo 2^64 is its hash.
_SHORT_WORD = 255


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each number over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def fold_words(text: str) -> list[str]:
    """The words of a text, A-Z in lower case."""
    return _WORD.findall(text.encode().translate(_FOLD).decode())


def shingle_set(text: str, size: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    """The distinct shingles of a text in full; with fewer words, all words as one; without words, none."""
    words = fold_words(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


class Block:
    """Words and shingles of some texts; ``norm`` has their words in lower case with one blank after each."""

    def __init__(self, shingler: Shingler, texts: list[bytes]):
        self.size = shingler.size
        joined = b" ".join(texts).translate(_FOLD)
        data = np.frombuffer(joined, np.uint8)
        powers, inverse = shingler.powers_to(len(data))
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = data != 32
        edges = np.flatnonzero(np.diff(inside))
        begins, ends = edges[::2], edges[1::2]
        lengths = ends - begins
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        word = mix((sums[ends] - sums[begins]) * inverse[begins] + lengths.astype(np.uint64) * _ODD[1])
        # A polynomial modulo 2^64 tells short words apart; long ones could be made to collide.
        for k in np.flatnonzero(lengths > _SHORT_WORD).tolist():
            word[k] = xxhash.xxh3_64_intdigest(joined[begins[k] : ends[k]])
        count = len(word) - self.size + 1
        rolled = np.zeros(max(count, 0), np.uint64)
        for k in range(self.size):
            rolled += word[k : k + max(count, 0)] * _ODD[2 + k]
        self.rolled, self.word = mix(rolled), word
        stops = np.cumsum([len(t) + 1 for t in texts])
        self.firsts = np.searchsorted(begins, np.concatenate(([0], stops[:-1])))
        self.lasts = np.concatenate((self.firsts[1:], [len(word)]))
        spaced = inside[1:-1].astype(bool)
        spaced[1:] |= inside[1:-2].astype(bool)
        self.norm = data[spaced].tobytes() + (b" " if len(data) and data[-1] != 32 else b"")
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1))).astype(np.int64)
        self._codes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.firsts)

    def places(self, k: int) -> np.ndarray:
        """The hash of the shingle at each place of a text, repeats included; see :func:`shingle_set` for few words."""
        first, last = int(self.firsts[k]), int(self.lasts[k])
        if last - first >= self.size:
            return self.rolled[first : last - self.size + 1]
        if last > first:
            few = self.word[first:last] * _ODD[2 : 2 + last - first]
            return mix(few.sum(keepdims=True) + np.uint64(last - first))
        return self.rolled[:0]

    def words(self, k: int) -> bytes:
        """The words of a text in lower case, one blank after each."""
        return self.norm[self.offsets[self.firsts[k]] : self.offsets[self.lasts[k]]]

    @property
    def codes(self) -> np.ndarray:
        """A number for each word; equal numbers stand for equal words, byte for byte."""
        if self._codes is None:
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.word), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.norm)])
            self._codes = words.dictionary_encode().indices.to_numpy()
        return self._codes

    def _equal(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether the shingles at these places are the same words."""
        return all(np.array_equal(self.codes[x + k], self.codes[y + k]) for k in range(self.size))

    def shared(self, i: int, j: int) -> tuple[int, int, int]:
        """Sizes of the sets of two texts of ``size`` words or more, and of what they share, by words and not by hashes."""
        (x, at_x), (y, at_y) = self._set(i), self._set(j)
        _, in_x, in_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if at_x is None or at_y is None or not self._equal(at_x[in_x], at_y[in_y]):
            one, other = shingle_set(self.words(i).decode(), self.size), shingle_set(self.words(j).decode(), self.size)
            return len(one), len(other), len(one & other)
        return len(x), len(y), len(in_x)

    def _set(self, k: int) -> tuple[np.ndarray, np.ndarray | None]:
        """The distinct hashes of a text and a place of each; no places where different shingles have one hash."""
        found, first, back = np.unique(self.places(k), return_index=True, return_inverse=True)
        start = int(self.firsts[k])
        alike = self._equal(np.arange(len(back)) + start, first[back] + start)
        return found, first + start if alike else None


class Shingler:
    """Hashes the shingles of texts; keeps tables of powers for blocks of BLOCK_BYTES."""

    def __init__(self, size: int = SHINGLE_WORDS):
        self.size, self.powers, self.inverse = size, _powers(_BASE, 1), _powers(_BASE_INVERSE, 1)

    def powers_to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers up to the n-th; those that only a text over BLOCK_BYTES needs aren't kept."""
        if len(self.powers) > n:
            return self.powers, self.inverse
        made = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)
        if n <= 2 * BLOCK_BYTES:
            self.powers, self.inverse = made
        return made

    def block(self, texts: list[bytes]) -> Block:
        return Block(self, texts)

    def hashes(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text, the hash of the shingle at each place, repeats included."""
        block = self.block(texts)
        return [block.places(k) for k in range(len(block))]


@functools.cache
def shingler() -> Shingler:
    """The one of this worker."""
    return Shingler()


def blocks(texts: Iterable, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Runs of encoded texts of about ``most`` bytes, at least one text each; texts are str or Arrow strings."""
    block: list[bytes] = []
    size = 0
    for text in texts:
        data = text.encode() if isinstance(text, str) else text.as_buffer().to_pybytes()
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append(data)
        size += len(data)
    if block:
        yield block
