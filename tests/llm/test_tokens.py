"""Byte-level BPE, token-id files and WARC archives against the libraries and exact round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tidelog.llm import units as unit_table
from tidelog.llm import warc
from tidelog.llm.byte_bpe import Encoder, bpe_digest, bpe_tokens
from tidelog.llm.queries import queries
from tidelog.llm.shared import new_folder, table
from tidelog.llm.token_files import CHUNK_IDS, PlaneReader, PlaneWriter, UnitEncoder, read_token_files, token_file_digest, write_token_files
from tidelog.llm.units import units
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "",
    " ",
    "  a",
    "a  b\n c",
    "a" * 501,
    "ab" * 300 + " " + "ba" * 299,
    " x 　 y",
    "naïve café ＡＢ 1234567 it's I'LL 'tis",
    "\x1c a \x1d\x1d b\x85 c",
    "日本語テキスト abc 12 _a __ b_",
    "x _y  _z ²³ ½ a é ́ x",
    "<|endoftext|> a <|endoftext|>",
    "a\n\n b \n c\t d\r\n",
    "one, two. three!? (four) ...five; six:seven's",
    "\U0001f600 \U0001f468‍\U0001f469 ok",
]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n):
    rng = random.Random(n)
    return "".join(rng.choice("aab  \n.,'sé日0²́_A") for _ in range(n))


def test_bpe_is_that_of_the_library(library):
    texts = TEXTS + [noise(n) for n in range(1, 400, 7)]
    own = Encoder(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_units_join_to_the_text():
    for text in TEXTS + [noise(n) for n in range(1, 200, 3)]:
        assert " ".join(units(text)) == text


def test_bpe_rows(make, library):
    docs = make([(None, "a b"), (1, None), (1, "a b"), (2, "a b"), (3, "x" * 100_000)])
    found = bpe_tokens(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in found] == [library.encode_ordinary(t) for t in ("a b", "", "a b", "a b", "x" * 100_000)]
    assert [bytes(r["decoded"]) for r in found][:2] == [b"a b", b""]
    assert bpe_digest(make([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for row in queries()["op7_byte_bpe"](spark, SF).collect():
        ids = np.array(library.encode_ordinary(texts[row["doc_id"]]), "<u4").tobytes()
        decoded = hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded)


# Token-id files


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    return own


def test_units_give_the_library_s_ids(tokenizer):
    texts = TEXTS + [noise(n) for n in range(1, 400, 7)]
    for _ in range(2):
        own = UnitEncoder(TOKENIZER)
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("lengths", [[], [0], [1], [0, 0, 3], [CHUNK_IDS], [CHUNK_IDS - 1, 1, 1], [5, 3 * CHUNK_IDS + 7, 2]])
def test_files_round_trip(lengths):
    rng, sink = np.random.default_rng(1), io.BytesIO()
    docs = [(None if k == 1 else k - 5, rng.integers(0, 2**32, n, np.uint32).tobytes()) for k, n in enumerate(lengths)]
    writer = PlaneWriter(sink)
    for doc in docs:
        writer.add(*doc)
    writer.close()
    reader = PlaneReader(sink)
    assert list(reader.documents()) == docs
    assert all(len(chunk) == CHUNK_IDS for chunk in list(reader.chunks())[:-1])


def test_a_cut_file_is_refused():
    sink = io.BytesIO()
    writer = PlaneWriter(sink)
    writer.add(1, b"\0" * 40)
    writer.close()
    with pytest.raises(ValueError):
        PlaneReader(io.BytesIO(sink.getvalue()[:-1]))


def test_token_file_query(spark, tokenizer):
    rows = sorted(table(spark, SF, "documents").collect(), key=lambda r: r["doc_id"])
    found = sorted(queries()["op6_token_files"](spark, SF).collect(), key=lambda r: r["doc_id"])
    start = 0
    for row, own in zip(rows, found, strict=True):
        ids = np.array([*tokenizer.encode(row["text"], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(own) == (row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(make, spark):
    docs = make([(3, "b"), (None, "c"), (3, "a"), (1, None), (2, "")])
    found = sorted(token_file_digest(docs, TOKENIZER, 2).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in found] == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 2), (3, 6, 2)]
    folder = new_folder(spark, "none")
    assert read_token_files(spark, write_token_files(make([]), TOKENIZER, 2, folder), folder).count() == 0


def test_added_tokens_in_texts_keep_their_ids(make):
    """Against the library as it is, without encode_special_tokens."""
    own = Tokenizer.from_file(TOKENIZER)
    texts = [*TEXTS, *(noise(n) for n in range(1, 200, 7)), "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n<|endoftext", "a b <|endoftext| > c"]
    ids = [own.encode(text, add_special_tokens=False).ids for text in texts]
    assert ids[-4] == [64, 220, 50256, 275]
    assert [np.frombuffer(found, "<u4").tolist() for found in UnitEncoder(TOKENIZER, added_tokens=True).encode(texts)] == ids
    found = sorted(token_file_digest(make(texts), TOKENIZER, 2).collect(), key=lambda r: r["doc_id"])
    start = 0
    for k, (row, wanted) in enumerate(zip(found, ids, strict=True)):
        whole = np.array([*wanted, 2], "<u4")
        assert tuple(row) == (k, start, len(whole), zlib.crc32(whole.tobytes())), texts[k]
        start += len(whole)


def test_tables_of_units_forget(monkeypatch, library, tokenizer):
    monkeypatch.setattr(unit_table, "TABLE_UNITS", 40)
    texts = [noise(n) for n in range(1, 900, 3)]
    one, other = Encoder(RANKS, public_tokenizers.PATTERN), UnitEncoder(TOKENIZER)
    for at in range(0, len(texts), 9):
        part = texts[at : at + 9]
        assert [np.frombuffer(x, "<u4").tolist() for x in one.encode(part)] == [library.encode_ordinary(t) for t in part]
        assert [np.frombuffer(x, "<u4").tolist() for x in other.encode(part)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert len(other.table.names) <= 40 + sum(len(units(t)) for t in part)


def test_other_patterns_and_pre_tokenizers_take_whole_texts(tmp_path, library):
    texts = TEXTS + [noise(n) for n in range(1, 200, 7)]
    pattern = r"\w+ |\W|\w+"
    own = Encoder(RANKS, pattern)
    assert own.table is None
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [other.encode_ordinary(t) for t in texts]
    from tokenizers import pre_tokenizers

    changed = Tokenizer.from_file(TOKENIZER)
    changed.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    changed.save(str(tmp_path / "changed.json"))
    own = UnitEncoder(str(tmp_path / "changed.json"), added_tokens=True)
    assert not own.by_units
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [changed.encode(t, add_special_tokens=False).ids for t in texts]


# WARC


def test_records_are_gzip_members_of_the_format():
    data = b"".join(warc.capture_records(7, "http://a.org/x y\r\n", "<p>é</p>".encode(), None))
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\n")
    response, request, meta = warc.parse_records(io.BytesIO(data))
    assert response["payload"] == "<p>é</p>".encode() and response["http_length"] == 9
    assert request["concurrent_to"] == meta["concurrent_to"] == response["record_id"]
    assert meta["fields"] == {"page-id": "7", "payload-length": "9"}


def test_plain_archives_and_payloads_with_marks():
    payload = b"WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x" + bytes(range(256)) * 9000
    data = gzip.decompress(b"".join(warc.capture_records(1, "u", payload, None) + warc.capture_records(2, "u", payload, 1)))
    rows = list(warc.parse_records(io.BytesIO(data)))
    assert [r["warc_type"] for r in rows] == ["response", "request", "metadata", "revisit", "request", "metadata"]
    assert rows[0]["payload"] == payload and rows[3]["payload"] == b"" and rows[3]["refers_to"] == rows[0]["record_id"]
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(data[:-400])))
    with pytest.raises(ValueError):
        list(warc.parse_records(io.BytesIO(data.replace(b"WARC-Type: x", b"WARC-Type: y"))))


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, largest string")


def test_captures(spark):
    rows = [(1, "u", "same"), (5, "v", "same"), (3, None, "same"), (2, "u", None), (4, "u", ""), (6, "u", "é" * 200_000), (5, "v", "same")]
    found = warc.archive_pages(pages_of(spark, rows)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {"same": 5, "": 4, "é" * 200_000: 6}
    expected = [(i, len((t or "").encode()), digest(t), "response" if last[t or ""] == i else "revisit", None if last[t or ""] == i else last[t or ""]) for i, _, t in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_captures_without_ids_and_rows(spark):
    found = warc.archive_pages(pages_of(spark, [(None, "u", "a"), (None, "u", "b"), (9, "u", "b")])).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=repr) == [(9, "response", None), (None, "response", None), (None, "revisit", 9)]
    assert warc.archive_pages(pages_of(spark, [])).count() == 0


def test_assembly_follows_links_both_ways(spark):
    fields = "record_id string, warc_type string, concurrent_to string"
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("q2", "request", None), ("r2", "response", "q2"), ("m1", "metadata", "r1"), ("m0", "metadata", "r1"), ("m9", "metadata", "gone"), ("r3", "resource", None)]
    found = {r["capture_id"]: (r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"]) for r in warc.assemble_captures(spark.createDataFrame(rows, fields)).collect()}
    assert found == {"r1": ("q1", "m0"), "r2": ("q2", None), "r3": (None, None)}
