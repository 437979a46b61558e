"""Exact, line and near deduplication against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F
from tidelog.llm import near_dedup as near
from tidelog.llm.components import connected_components
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.line_dedup import cut_rows, line_dedup
from tidelog.llm.near_dedup import near_dedup
from tidelog.llm.shared import Scratch
from tidelog.llm.shingles import Shingler, blocks, fold_words, shingle_set


def exact_by_hand(pairs):
    groups = {}
    for doc_id, text in pairs:
        normal = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(normal, []).append((-len(text or ""), doc_id))
    out = {}
    for normal, rows in groups.items():
        keep = min(rows)[1]
        for _, doc_id in rows:
            out[doc_id] = (keep, len(rows), doc_id == keep, hashlib.sha256(normal.encode()).hexdigest())
    return out


EXACT = [(5, "a b"), (3, "ab"), (9, "a\t\nb"), (1, "a b"), (2, None), (4, ""), (6, " \x0b"), (7, "é"), (8, "é "), (10, "x" * 300_000), (11, "x" * 300_000)]


def test_exact(make):
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(make(EXACT)).collect()}
    assert found == exact_by_hand(EXACT)


@pytest.mark.parametrize("weak", [lambda c: F.lit(b"same"), lambda c: F.substring(c, 1, 1).cast("binary")])
def test_exact_compares_bytes_when_hashes_collide(make, weak):
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(make(EXACT), weak).collect()}
    assert found == exact_by_hand(EXACT)


def test_exact_repeated_rows_and_null_ids(make):
    found = exact_dedup(make([(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()
    rows = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found), key=repr)
    assert rows == [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)]


def test_empty_tables(make, spark):
    empty = make([])
    assert exact_dedup(empty).count() == line_dedup(empty).count() == near_dedup(empty).count() == 0


def lines_by_hand(pairs):
    seen, out = set(), {}
    for doc_id, text in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0]):
        lines, gone = (text or "").split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if any(x.strip(" ") for x in window):
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[doc_id] = (kept if gone else text, len(lines), len(gone))
    return out


LINES = [
    (1, "a\nb\nc\nd\ne"),
    (2, "x\na\nb\nc\nd\ny\nz"),
    (3, "a\nb\nc"),
    (4, "a\nb"),
    (5, None),
    (6, ""),
    (7, "\n\n\n\n\n"),
    (8, "\n\n\n\nq"),
    (9, "p\np\np\np\np\nq"),
    (10, "n\nd\ne\na\nb\nc\nd\ne\nm\nb\nc\nd"),
    (0, "b\nc\nd"),
    (12, "\n".join(f"line {k % 700}" for k in range(3000))),
]


def test_lines(make):
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup(make(LINES)).collect()}
    assert found == lines_by_hand(LINES)


def test_lines_null_and_repeated_ids(make):
    found = line_dedup(make([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in found) == [(0, 0), (1, 0), (1, 0), (2, 3)]


def test_cut_rows_keeps_all_columns(make):
    docs = make(LINES)
    assert cut_rows(docs).select("row.*").columns == docs.columns


def test_shingles():
    texts = ["", "a b", "  A  B\t c\x0bd e f  ", "É é É é É é", "x" * 10, "a b c d e " * 40]
    shingler = Shingler()
    hashes = [h for block in blocks(texts, 40) for h in shingler.hashes(block)]
    known = {}
    for text, own in zip(texts, hashes, strict=True):
        assert len(set(own.tolist())) == len(shingle_set(text))
        words = fold_words(text)
        for shingle, h in zip([tuple(words[k : k + 5]) for k in range(len(words) - 4)], own.tolist(), strict=False):
            assert known.setdefault(shingle, h) == h
    assert len(set(known.values())) == len(known)


def components_by_hand(pairs):
    sets = {i: shingle_set(t or "") for i, t in pairs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def near_rows(words):
    """Texts alone, chains of edits, a large group of near copies, boilerplate with little else, short and empty texts."""
    docs = [" ".join(words(n)) for n in (3, 5, 40, 300, 900)]
    base = words(150)
    for k in range(30):  # a chain: each is near the one before, the ends aren't
        base = base[4:] + words(4)
        docs.append(" ".join(base))
    centre = words(200)
    for k in range(60):
        own = list(centre)
        for w in words(3):
            own[hash((k, w)) % len(own)] = w
        docs.append(" ".join(own))
    notice = words(60)
    docs += [" ".join(notice + words(n % 40)) for n in range(80)]
    docs += [" ".join(words(4) + notice) for _ in range(20)]
    docs += ["", None, "  \n", "one two", "ONE  two", "one two three", docs[3], docs[3].upper() if docs[3].isascii() else docs[3]]
    return list(enumerate(docs))


def test_near(make, words):
    pairs = near_rows(words)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(make(pairs)).collect()}
    assert found == components_by_hand(pairs)


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate({97: 98, 98: 97})
    return word


def test_near_words_that_a_polynomial_cannot_tell_apart(make):
    word = thue_morse(11)
    other = word.translate({97: 98, 98: 97})
    pairs = [(1, word), (2, other), (3, f"{word} b c d e {other} b c d e"), (4, f"{word} b c d e"), (5, f"{other} b c d e")]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(make(pairs)).collect()}
    assert found == components_by_hand(pairs)


def test_shared_shingles_are_counted_by_words():
    shingler = Shingler()
    block = shingler.block([b"a b c d e f g", b" A  b c\td e x f g ", b"q r s t u"])
    block.rolled[:] = 7  # all hashes collide
    assert block.shared(0, 1) == (3, 4, 1)
    assert block.shared(0, 2) == (3, 1, 0)
    assert Shingler().block([b"a b c d e f g", b" A  b c\td e x f g "]).shared(0, 1) == (3, 4, 1)
    assert block.words(1) == b"a b c d e x f g "


def test_near_large_group_without_a_centre(make, words):
    """Near copies of a text that is not there, some near each other and most not."""
    rng = random.Random(3)
    centre, docs = words(150), []
    for _ in range(300):
        own = list(centre)
        for w in words(rng.randint(1, 7)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 2)] = [w]
        docs.append(" ".join(own))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(make(docs)).collect()}
    assert found == components_by_hand(list(enumerate(docs)))


def test_near_very_long_texts(make, words):
    long = words(450_000)
    docs = [" ".join(long), " ".join(long[9:]), " ".join(words(20) + long[60_000:]), " ".join(long[:300_000])]
    assert len(docs[0]) > near.BLOCK_BYTES
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(make(docs)).collect()}
    assert found == components_by_hand(list(enumerate(docs)))


def test_near_rows_of_one_id_join_their_links(make):
    one, other = "a b c d e f g h", "p q r s t u v w"
    found = near_dedup(make([(1, one), (5, one), (5, other), (9, other), (7, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1)]


def test_near_null_and_repeated_ids(make):
    text = "a b c d e f g h"
    found = near_dedup(make([(None, text), (4, text), (2, text), (2, text), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (0, 0, True), (2, 2, True), (2, 2, True), (4, 2, False)]


def test_near_threshold_is_inclusive(make):
    # 6 of 8 shingles are shared: 75 %.
    base = [f"w{k}" for k in range(11)]
    pairs = [(1, " ".join(base)), (2, " ".join([*base[:10], "x"])), (3, " ".join([*base[:9], "y", "z"]))]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup(make(pairs)).collect()}
    assert found == {i: c for i, (_, c, _) in components_by_hand(pairs).items()}


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 120) if k % 40] + [(200, k) for k in range(300, 400)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {k: 1 + 40 * ((k - 1) // 40) for k in range(1, 121)} | {k: 200 for k in (200, *range(300, 400))}
    assert found == expected


def test_stars_and_no_links_take_no_steps(spark, monkeypatch):
    made, write = [], Scratch.written
    monkeypatch.setattr(Scratch, "written", lambda self, df, name: made.append(name) or write(self, df, name))
    links = spark.createDataFrame([(1, 5), (7, 1), (1, 9), (20, 30)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(links).collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 20: 20, 30: 20}
    assert connected_components(links.limit(0)).count() == 0
    # The links and the result of each.
    assert len(made) == 4


def test_prefixes_follow_the_bound():
    assert near.SKETCH * near.PERCENT // 100 == near.WHOLE
