"""The pipeline and the queries of the subpackage."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from oracle import connect, spark_rows, sql_rows
from tidelog.llm.byte_bpe import Encoder
from tidelog.llm.language_id import identify_languages
from tidelog.llm.queries import oracle_sql, queries
from tidelog.llm.shared import table
from tidelog.llm.shingles import shingle_set

from llm.test_dedup import components_by_hand, lines_by_hand

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    result = queries()[name](spark, SF)
    if name in oracle_sql():
        assert spark_rows(result) == sql_rows(connect(SF), oracle_sql()[name])
    else:
        assert result.count() == table(spark, SF, "documents").count()


def test_pipeline_is_what_plain_code_makes(spark):
    docs = table(spark, SF, "documents")
    named = {r["doc_id"]: r for r in identify_languages(docs).collect()}
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if named[r["doc_id"]]["lang_pred"] != "und" and named[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    cut = lines_by_hand(list(kept.items()))
    kept = {i: text for i, (text, _, removed) in cut.items() if not removed or text.strip(" \t\n\x0b\x0c\r")}
    groups = components_by_hand(list(kept.items()))
    kept = {i: text for i, text in kept.items() if groups[i][2]}
    items = [shingle_set(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not any(100 * len(s & shingle_set(t)) >= 75 * len(s) for s in items)}
    import public_tokenizers

    own = Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = {i: (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, t), x in zip(kept.items(), own.encode(list(kept.values())), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()} == expected


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_odd_rows(make, spark):
    docs = make([(None, "the and of"), (1, None), (1, ""), (2, "the and of"), (2, "the and of")], {2: "en"})
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() <= 5
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_decisions_on_odd_rows(make, spark, words):
    stages = dict(corpus_pipeline.STAGES)
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    text = " ".join(words(40))
    held = make([(None, f"{text} {item} {text}"), (None, text), (3, item), (3, text), (4, None)])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in stages["decontamination"](spark, held, SF).collect() if r["text"]) == [(0, text), (3, text)]
    lines = "one\ntwo\nthree"
    cut = stages["line_dedup"](spark, make([(1, lines), (2, f"\n{lines}\n\t"), (3, "\n\n\n"), (None, lines), (5, None)]), SF)
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in cut.collect()), key=repr) == [(0, lines), (1, lines), (3, "\n\n\n"), (5, None)]
    near = stages["near_dedup"](spark, make([(1, text), (2, text), (None, text), (None, text), (5, None), (6, ""), (7, "")]), SF)
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 0, 1, 5, 6, 7]
