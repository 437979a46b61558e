"""Language identification: the language family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import releasing, text_or_empty
from tidelog.llm.units import text_blocks

UNKNOWN = "und"
#: Rows that a model is fitted on: the bound for one language and for all together.
SAMPLE_PER_LANGUAGE = 500
SAMPLE_ALL = 6000
# Language families by ISO 639-1 codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "finnic": ("fi", "et"),
    "indo-aryan": ("hi", "bn", "mr", "ur", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Hashed features of three and of four bytes each.
_BUCKETS = 1 << 15
#: Bytes of a model's weights. With more labels, and so more decisions, features share buckets to keep within it.
MODEL_BYTES = 64 << 20
#: Families that are no more are kept as they are; with more, labels of no known family are put together by likeness.
MOST_FAMILIES = 16
#: Bytes of text whose features are summed at a time.
_BLOCK_BYTES = 1 << 18
_LETTERS = bytes(x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def _normal(text: str) -> bytes:
    """The text in lower case with one blank for whatever stands between letters, and at both ends; four bytes at least."""
    return (b" " + b" ".join(text.lower().encode(errors="replace").translate(_LETTERS).split()) + b" ").ljust(4, b"\0")


def _features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the three and the four bytes that begin at each place; those of the last places go over the end.

    A model with fewer buckets takes the upper bits of these (:func:`_fold`).
    """
    x = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    three = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16)
    four = three | x[3:] << np.uint32(24)
    return (three * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64), (four * np.uint32(2246822519) >> np.uint32(17)).astype(np.int64) + _BUCKETS


def _fold(at: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of 15 bits, the second half of which are those of four bytes, as buckets of fewer bits."""
    return ((at % _BUCKETS) >> (15 - bits)) + (at // _BUCKETS << bits)


def _folded(at: np.ndarray, share: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits == 15:
        return at, share
    found, back = np.unique(_fold(at, bits), return_inverse=True)
    return found, np.bincount(back, share)


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of each, which add up to 2."""
    data = _normal(text)
    three, four = _features(data)
    n = max(1, len(data) - 3)
    found, counts = np.unique(np.concatenate((three[:n], four[:n])), return_counts=True)
    return found, counts / n


class Decision(NamedTuple):
    """A linear separator: over 0 stands for ``over``, else for ``under``; slope turns the margin into odds."""

    over: str
    under: str
    slope: float


class LanguageModel:
    """Separators as columns of one weight table: first those between families, then those inside them."""

    def __init__(self, languages: list[str], families: dict[str, list[str]], decisions: list[Decision], weights: np.ndarray, bias: np.ndarray, bits: int = 15):
        self.languages, self.families, self.decisions, self.bits = languages, families, decisions, bits
        self.weights, self.bias = weights.astype(np.float32), bias

    def margins(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a separator, over whole texts."""
        data = [_normal(t) for t in texts]
        out = np.empty((len(texts), len(self.decisions)))
        at = 0
        while at < len(data):
            stop, size = at, 0
            while stop < len(data) and (stop == at or size + len(data[stop]) <= _BLOCK_BYTES):
                size += len(data[stop])
                stop += 1
            out[at:stop] = self._block(data[at:stop]) if size <= _BLOCK_BYTES else self._long(data[at])
            at = stop
        return out + self.bias

    def _sums(self, data: bytes) -> np.ndarray:
        three, four = _features(data)
        if self.bits < 15:
            three, four = _fold(three, self.bits), _fold(four, self.bits)
        return self.weights[three] + self.weights[four]

    def _block(self, data: list[bytes]) -> np.ndarray:
        lengths = np.array([len(x) for x in data])
        ends = np.cumsum(lengths)
        each = self._sums(b"".join(data))
        for k in (1, 2, 3):  # features that go over the end of a text don't count, if it has others
            each[ends[lengths > 3] - k] = 0
        return np.add.reduceat(each, ends - lengths, axis=0, dtype=np.float64) / np.maximum(lengths - 3, 1)[:, None]

    def _long(self, data: bytes) -> np.ndarray:
        """A text over the size of a block, piece by piece."""
        n, total = len(data) - 3, np.zeros(len(self.decisions))
        for at in range(0, n, _BLOCK_BYTES):
            m = min(_BLOCK_BYTES, n - at)
            total += self._sums(data[at : at + m + 3])[:m].sum(axis=0, dtype=np.float64)
        return total / n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        margins = self.margins(texts) if self.decisions else np.zeros((len(texts), 0))
        languages, scores = [], []
        for text, row in zip(texts, margins.tolist(), strict=True):
            language, score = self._decide(row) if has_letter(text) else (UNKNOWN, 0.0)
            languages.append(language)
            scores.append(score)
        return languages, scores

    def _decide(self, row: list[float]) -> tuple[str, float]:
        odds = {(d.over, d.under): 1 / (1 + np.exp(-min(50, max(-50, d.slope * m)))) for d, m in zip(self.decisions, row, strict=True)}
        names = list(self.families)
        family, score = _winner(names, odds)
        language, inner = _winner(self.families[family], odds)
        return language, float(score * inner)


def _winner(names: list[str], odds: dict[tuple[str, str], float]) -> tuple[str, float]:
    """Who wins most one-versus-one decisions, ties by the sum of odds; and the lowest odds it has."""
    if len(names) == 1:
        return names[0], 1.0
    own = {n: [p if a == n else 1 - p for (a, b), p in odds.items() if n in (a, b)] for n in names}
    best = max(names, key=lambda n: (sum(p > 0.5 for p in own[n]), sum(own[n])))
    return best, min(own[best])


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = 100.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent (Hsieh et al., 2008)."""
    weights, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1e-4 for _, v in rows]) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            at, value = rows[k]
            gradient = signs[k] * (float(weights[at] @ value) + bias) - 1 + alpha[k] * 0.5 / cost
            new = max(0.0, alpha[k] - gradient / norms[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * signs[k]
                weights[at] += step * value
                bias += step * 1e-4
                alpha[k] = new
    return weights, bias


def _slope(margins: np.ndarray, signs: np.ndarray) -> float:
    """The slope of a logistic curve through 0 over the margins, kept so that a margin of 1 isn't a certainty."""
    slope = 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * margins * signs, -50, 50)))
        gradient = float(((1 - p) * margins * signs).mean()) - 0.01 * slope
        curve = float((p * (1 - p) * margins**2).mean()) + 0.01
        slope = min(8.0, max(0.5, slope + gradient / curve))
    return slope


def _families(languages: list[str], sample: list[tuple[str, np.ndarray, np.ndarray]]) -> dict[str, list[str]]:
    """Known families and single labels; where that makes too many, single labels join the one of MOST_FAMILIES that is most like them."""
    families: dict[str, list[str]] = {}
    for language in languages:
        families.setdefault(_FAMILY_OF.get(language, language), []).append(language)
    if len(families) <= MOST_FAMILIES:
        return families
    centres = {language: np.zeros(1 << 11) for language in languages}
    for language, at, share in sample:
        np.add.at(centres[language], _fold(at, 10), share)
    for centre in centres.values():
        centre /= np.linalg.norm(centre) + 1e-12
    single = [name for name in families if name not in FAMILIES]
    # Each new seed is the label that is least like all seeds so far.
    seeds = [single[0]]
    while len(seeds) < min(len(single), max(1, MOST_FAMILIES - len(families) + len(single))):
        seeds.append(min((x for x in single if x not in seeds), key=lambda x: max(float(centres[x] @ centres[y]) for y in seeds)))
    grouped = {name: own for name, own in families.items() if name in FAMILIES} | {f"like {x}": [x] for x in seeds}
    # None gets much more than its share, as decisions inside a family grow with the square of its size.
    most = -(-3 * len(single) // (2 * len(seeds)))
    for language in single:
        if language not in seeds:
            room = [y for y in seeds if len(grouped[f"like {y}"]) < most]
            grouped[f"like {max(room, key=lambda y: float(centres[language] @ centres[y]))}"].append(language)
    return grouped


def fit_languages(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """Fits separators between families and between the languages of each, on (language, buckets, shares)."""
    languages = sorted({x[0] for x in sample})
    families = _families(languages, sample)
    tasks = [(a, b, set(families[a]), set(families[b])) for a, b in itertools.combinations(families, 2)]
    tasks += [(a, b, {a}, {b}) for own in families.values() for a, b in itertools.combinations(own, 2)]
    bits = 15
    while bits > 8 and (2 << bits) * len(tasks) * 4 > MODEL_BYTES:
        bits -= 1
    if (2 << bits) * len(tasks) * 4 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} labels need {len(tasks)} decisions, which a model of {MODEL_BYTES} bytes can't hold")
    sample = [(language, *_folded(at, share, bits)) for language, at, share in sample]
    decisions, weights, biases = [], np.zeros((2 << bits, len(tasks)), np.float32), np.zeros(len(tasks))
    for k, (over, under, its, other) in enumerate(tasks):
        rows = [(at, share) for language, at, share in sample if language in its or language in other]
        signs = np.array([1.0 if language in its else -1.0 for language, *_ in sample if language in its or language in other])
        fitted, biases[k] = fit_svm(rows, signs, 2 << bits)
        weights[:, k] = fitted
        margins = np.array([float(fitted[at] @ share) + biases[k] for at, share in rows])
        decisions.append(Decision(over, under, _slope(margins, signs)))
    return LanguageModel(languages, families, decisions, weights, biases, bits)


def held_out() -> Column:
    """Whether a document is kept from learning, by its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def sample_of(docs: DataFrame, per_language: int, all_rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, shares) of a sample of the rows of docs(doc_id, text, lang) with a lang that are not held out.

    The rows of each language are counted; of those with many, the ones with the smallest hash of their id are taken,
    ``per_language`` each at most and ``all_rows`` in all, or one each where there are more labels than that. Features
    are taken of whole texts on the executors, so what comes to the driver is bounded by these numbers and the number of
    features. Fitting is deterministic.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    each = max(1, min(per_language, all_rows // len(counts)))
    # A share of the ids by their hash, with more than enough rows; of these few, the first by the hash.
    share = F.create_map(*(F.lit(x) for language, n in sorted(counts.items()) for x in (language, min(1.0, (1.5 * each + 40) / n))))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)))
    some = rows.filter(F.col("h") < F.element_at(share, F.col("lang")) * float(1 << 53))
    taken = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))).filter(F.col("place") <= each)

    def features(batches):
        for batch in batches:
            found = [(language, *text_features(text)) for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(text)]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            lists = [pa.array([x.astype(kind) for x in c], pa.list_(t)) for c, kind, t in zip(columns[1:], (np.int32, np.float32), (pa.int32(), pa.float32()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *lists], ["lang", "buckets", "shares"])

    found = taken.select("lang", "text").mapInArrow(lambda batches: releasing(features(batches)), "lang string, buckets array<int>, shares array<float>").toArrow()
    sample = [(language.as_py(), at.values.to_numpy(), v.values.to_numpy().astype(float)) for language, at, v in zip(*found.columns, strict=True)]
    # Rows come in any order; the fit goes over them in one order.
    return sorted(sample, key=lambda x: (x[0], len(x[1]), x[1].tobytes(), x[2].tobytes()))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, all_rows: int = SAMPLE_ALL) -> LanguageModel:
    """A model of docs(doc_id, text, lang), from a bounded sample (:func:`sample_of`)."""
    return fit_languages(sample_of(docs, per_language, all_rows))


def _predicted(model: LanguageModel, texts: pa.Array) -> pa.Array:
    languages, scores = [], []
    for block in text_blocks(texts, _BLOCK_BYTES):
        for out, found in zip((languages, scores), model.predict(block.to_pylist()), strict=True):
            out += found
    return pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])


def language_of(model: LanguageModel, docs: DataFrame) -> Column:
    """A column (lang_pred, score) of docs' column text by the model, which is broadcast; its weights take MODEL_BYTES at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return releasing(_predicted(shared.value, texts) for texts in batches)

    return predict(text_or_empty("text"))


def identify_languages(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score.

    A model is fitted on rows that are not held out (:func:`train`), then every whole text is predicted from itself
    alone: linear separators between language families, one-versus-one, pick the family; linear SVMs between each two
    of its languages pick the language. score multiplies the lowest odds of the two winners.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything where there is nothing to
    learn from. Rows with a null doc_id are held out. Rows that repeat each other get equal results. Other columns of
    docs are ignored. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    named = rows.withColumn("found", language_of(train(docs), rows))
    return named.select("doc_id", "held_out", "found.lang_pred", "found.score")
