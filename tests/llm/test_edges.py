"""NULLs, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from campusflow.llm import (
    chat_format,
    decontamination,
    jaccard_join,
    license_scan,
    line_dedup,
    lm_scoring,
    mixing,
    quality_rules,
    secret_scan,
    substring_dedup,
    toxicity,
)


def _items(spark):
    rows = [(1, "word3 word4 word5"), (2, ""), (None, "word10 word11"), (3, None), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    return spark.createDataFrame(rows, "item_id long, text string")


# What keeps a row for each document.
PER_ROW = {
    "quality": lambda s, d: quality_rules.score_quality(d),
    "secrets": lambda s, d: secret_scan.find_secrets(d),
    "substrings": lambda s, d: substring_dedup.remove_repeated_passages(d),
    "substrings, hot": lambda s, d: substring_dedup.remove_repeated_passages(d, hot_bucket=0),
    "contamination": lambda s, d: decontamination.find_contamination(d, _items(s)),
    "contamination, blocks": lambda s, d: decontamination.find_contamination(d, _items(s), block_words=5),
    "contamination, none": lambda s, d: decontamination.find_contamination(d, _items(s).limit(0)),
    "lines": lambda s, d: line_dedup.remove_repeated_chunks(d),
    "similarity": lambda s, d: jaccard_join.similarity_components(d),
    "licenses": lambda s, d: license_scan.scan_licenses(d),
    "scores": lambda s, d: lm_scoring.score_corpus(d),
    "scores, no training": lambda s, d: lm_scoring.score_corpus(d, training=F.lit(False)),
    "mixture": lambda s, d: mixing.mix_sources(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d),
}
OWN_SHAPE = ("similarity", "licenses")
FILTERS = {
    "one of near": lambda s, d: jaccard_join.one_per_component(d),
    "benchmark cut": lambda s, d: decontamination.remove_contamination(d, _items(s), max_span_words=1, max_coverage=0.4),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_gets_a_result(spark, awkward, name):
    found = PER_ROW[name](spark, awkward)
    rows = found.collect()
    assert len(rows) == awkward.count()
    if name not in OWN_SHAPE:
        assert {c.lower() for c in awkward.columns} <= {c.lower() for c in found.columns}
        assert len({c.lower() for c in found.columns}) == len(found.columns)
        assert all(r["doc"] == "theirs" for r in rows)


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_the_columns(spark, awkward, name):
    found = FILTERS[name](spark, awkward)
    assert found.columns == awkward.columns
    left = sorted(repr(r) for r in found.collect())
    assert 0 < len(left) <= awkward.count()
    assert left != sorted(repr(r) for r in awkward.collect())


@pytest.mark.parametrize("name", [*PER_ROW, *FILTERS])
def test_empty_table(spark, awkward, name):
    call = PER_ROW.get(name) or FILTERS[name]
    assert call(spark, awkward.limit(0)).collect() == []


def test_texts_without_words(spark, awkward):
    wordless = awkward.filter("doc_id IN (1, 2, 3)")
    scored = quality_rules.score_quality(wordless).collect()
    assert {(r["n_words"], r["base_failed"], r["kept"]) for r in scored} == {(0, True, False)}
    kept = substring_dedup.remove_repeated_passages(wordless).collect()
    assert {(r["n_words"], r["n_removed"], r["kept_text"]) for r in kept} == {(0, 0, "")}
    linked = jaccard_join.similarity_components(wordless).collect()
    assert {(r["doc"], r["n_shingles"], r["component_id"]) for r in linked} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert jaccard_join.one_per_component(wordless).count() == 3
    assert {r["n_tokens"] for r in lm_scoring.score_corpus(wordless).collect()} == {1}
    assert {r["text"] for r in line_dedup.remove_repeated_chunks(wordless).collect()} == {None, "", " \t\n\x0b\f\r "}


def test_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 1, "system", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    found = chat_format.format_conversations(table, chat_format.marked_template).collect()
    assert sorted((r["conv_id"] or 0, r["place"], r["role"], r["text"]) for r in found) == [
        (0, 0, "", ""), (0, 1, "user", "a"), (1, 0, "system", ""), (1, 1, "user", "b"), (1, 2, "user", "b"),
    ]
    assert chat_format.format_conversations(table.limit(0), chat_format.marked_template).collect() == []
