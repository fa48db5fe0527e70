"""The pipeline against a version of plain loops and DuckDB statements."""

import duckdb
import pyarrow as pa

import corpus_pipeline
from campusflow.llm import mixing, quality_rules
from campusflow.llm.queries import DECONTAMINATION_SQL
from tests.llm.conftest import components

SF = "/root/testdata/sf0.001"


def _sql(text: str, **tables) -> list[dict]:
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, pa.Table.from_pylist(rows))
    return con.execute(text).to_arrow_table().to_pylist()


def _without_repeated_pairs(texts: dict[int, str]) -> dict[int, str]:
    """Neighbouring lines with words that an earlier place has go, with blank lines between them."""
    first, left = {}, {}
    for i in sorted(texts):
        lines = texts[i].split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\n\x0b\f\r")]
        gone = set()
        for a, b in zip(full, full[1:]):
            pair = "\n".join(lines[a : b + 1])
            at = first.setdefault(pair, (i, a, b))
            if at[0] != i or at[2] < a:
                gone |= set(range(a, b + 1))
        left[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return left


def test_stages_by_brute_force(spark, tmp_path):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.asDict() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    copy = max(d["doc_id"] for d in docs) + 1
    leak = next(i["text"] for i in items if len(i["text"].split()) > 20)
    docs.append(docs[0] | {"doc_id": copy})
    docs.append(docs[1] | {"doc_id": copy + 1, "text": docs[3]["text"] + "\n" + leak})
    folder = tmp_path / "tables"
    spark.createDataFrame(docs, corpus_pipeline_schema(spark)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    found = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(folder)).collect()), key=repr)

    kept = {r["doc_id"] for r in _sql(quality_rules.score_quality_sql(), documents=docs) if r["kept"]}
    docs = [d for d in docs if d["doc_id"] in kept]
    cut = _without_repeated_pairs({d["doc_id"]: d["text"] for d in docs})
    docs = [d | {"text": cut[d["doc_id"]], "n_chars": len(cut[d["doc_id"]])} for d in docs if cut[d["doc_id"]].strip()]
    low = components({d["doc_id"]: d["text"] for d in docs}, 5, 80)
    docs = [d for d in docs if low[d["doc_id"]] == d["doc_id"]]
    assert copy not in {d["doc_id"] for d in docs}
    hits = {r["doc_id"]: r for r in _sql(DECONTAMINATION_SQL, documents=docs, benchmark=items)}
    dirty = {i for i, r in hits.items() if r["n_hit"] > 9}
    assert copy + 1 in dirty
    clean = {d["doc_id"] for d in docs if hits[d["doc_id"]]["n_hit"] <= 0.5 * hits[d["doc_id"]]["n_words"]}
    after = {r["doc_id"]: r for r in corpus_pipeline.cut_benchmark(spark, spark.createDataFrame(docs, corpus_pipeline_schema(spark)), str(folder)).collect()}
    assert set(after) <= clean and clean - set(after) <= dirty
    assert all(after[d["doc_id"]].text == d["text"] for d in docs if d["doc_id"] in clean - dirty)
    rest = [r.asDict() for r in after.values()]
    assert all(not r["contaminated"] or r["n_hit"] <= 9 for r in _sql(DECONTAMINATION_SQL, documents=rest, benchmark=items))

    drawn = {r["doc_id"]: r for r in _sql(mixing.mix_sources_sql(), documents=rest) if r["sampled"]}
    expected = [
        (*(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")), *(drawn[r["doc_id"]][c] for c in ("topic", "n_tokens", "probability")))
        for r in rest
        if r["doc_id"] in drawn
    ]
    assert found == sorted(expected, key=repr)


def corpus_pipeline_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
