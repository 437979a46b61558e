"""Texts as units that byte-level BPE encodes one by one, and a table of the units' ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the pattern of byte-level BPE for which texts may be cut into units.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What any library may take for white space. A match of the pattern that has a blank before something else begins at
#: that blank, and what stands before the blank is matched alike without it.
_SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_CUT = re.compile(f" (?=[^{_SPACE}])")
_UNCUT = rf" (?:[{_SPACE}]|\z)"
#: Units that a table keeps, and the bytes of them and their ids.
TABLE_UNITS, TABLE_BYTES = 600_000, 64 << 20


def text_blocks(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes, at least one text each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def units(text: str) -> list[str]:
    """Pieces whose encodings, one after another, are the text's; all but the first lack the blank before them."""
    return _CUT.split(text)


def split_units(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of units of each text, and all units in a row."""
    if pc.any(pc.match_substring_regex(texts, _UNCUT)).as_py():
        lists = pa.array([units(text) for text in texts.to_pylist()], pa.large_list(pa.large_string()))
    else:
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def parts_of(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of values that begin at these starts, one after another."""
    stops = np.cumsum(lengths)
    return values[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - lengths), lengths)]


class UnitTable:
    """Ids of units with a blank before them that were seen before, in arrays.

    Beyond TABLE_UNITS or TABLE_BYTES it forgets those that it saw in the fewest blocks. ``learn`` takes units, and
    whether there is a blank before them, and gives all their ids in a row and the number of each.
    """

    def __init__(self, learn: Callable[[pa.Array, bool], tuple[np.ndarray, np.ndarray]]):
        self.learn = learn
        self._keep(None)

    def _keep(self, kept: np.ndarray | None) -> None:
        if kept is None:
            self.names, self.ids, self.counts, self.seen = pa.array([], pa.large_string()), np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            self.names = self.names.filter(pa.array(kept))
            self.ids = parts_of(self.ids, self.starts[kept], self.counts[kept])
            self.counts, self.seen = self.counts[kept], self.seen[kept] // 2
        self.starts = np.cumsum(self.counts) - self.counts

    def _shrink(self) -> None:
        if len(self.names) > TABLE_UNITS or self.names.nbytes + self.ids.nbytes > TABLE_BYTES:
            sizes, least = pc.binary_length(self.names).to_numpy(zero_copy_only=False) + 4 * self.counts, 2
            while (kept := self.seen >= least).sum() > TABLE_UNITS // 2 or sizes[kept].sum() > TABLE_BYTES // 2:
                least += 1
            self._keep(kept)

    def _rows(self, found: pa.Array) -> np.ndarray:
        """The place of each of these distinct units in the table; new ones are entered."""
        at = pc.index_in(found, value_set=self.names) if len(self.names) else pa.nulls(len(found), pa.int32())
        rows, new = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_null(at)
        fresh = found.filter(new)
        if len(fresh):
            ids, counts = self.learn(fresh, True)
            rows[rows < 0] = len(self.names) + np.arange(len(fresh))
            self.names = pa.concat_arrays([self.names, fresh])
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
            self.seen = np.concatenate((self.seen, np.zeros(len(fresh), np.int64)))
            self.starts = np.cumsum(self.counts) - self.counts
        self.seen[rows] += 1
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts in a row, and the number of ids of each text."""
        self._shrink()
        counts, flat = split_units(texts)
        begins = np.cumsum(counts) - counts
        later = np.ones(len(flat), bool)
        later[begins] = False
        first = flat.take(pa.array(begins)).dictionary_encode()
        coded = flat.filter(pa.array(later)).dictionary_encode()
        rows = self._rows(coded.dictionary)
        first_ids, first_counts = self.learn(first.dictionary, False)
        lengths, starts = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
        place = rows[coded.indices.to_numpy()]
        lengths[later], starts[later] = self.counts[place], self.starts[place]
        place = first.indices.to_numpy()
        lengths[begins], starts[begins] = first_counts[place], len(self.ids) + (np.cumsum(first_counts) - first_counts)[place]
        ids = parts_of(np.concatenate((self.ids, first_ids)), starts, lengths)
        return ids, np.add.reduceat(lengths, begins)


def ids_of_texts(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    flat, stops = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(counts)).tolist()
    return [flat[i:j] for i, j in zip([0, *stops], stops, strict=False)]
