from __future__ import annotations

import corpus_pipeline
import pytest
from cases import DOCS, LONG, docs, prose

import __spark_entry__
from siftworks.llm import queries
from siftworks.session import staged, work_dir

KEY = "AK" + "IA" + "Q" * 16
ROWS = [
    *DOCS,
    (40, prose(40, 200)),
    (41, prose(40, 200) + " end"),
    (42, prose(42, 100) + " " + prose(43, 30)),
    (43, f"{prose(44, 50)} key {KEY} {prose(45, 50)}"),
    *[(100 + i, " ".join(w + "&&&" for w in prose(300 + i, 50).split())) for i in range(30)],
]


@pytest.fixture(scope="module")
def sf_dir(spark, frame):
    folder = work_dir(spark, "tables")
    docs(frame, ROWS).write.parquet(f"{folder}/documents.parquet")
    marks = [(d, int(d < 100), 0) for d, _ in ROWS if d is not None]
    frame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame([(1, prose(43, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [staged(corpus_pipeline.good_quality(spark, table, sf_dir), "t")]
    for stage in (corpus_pipeline.deduplicated, corpus_pipeline.decontaminated, corpus_pipeline.without_secrets):
        kept.append(staged(stage(spark, kept[-1], sf_dir), "t"))
    assert all(k.columns == table.columns for k in kept)
    good, lone, clean, masked = ({r["doc_id"]: r["text"] for r in k.collect()} for k in kept)
    assert not any(d is not None and d >= 100 for d in good) and {1, 2, 8, 40, 41, 42, 43} <= good.keys()
    assert {1, 8, 40, 42, 43} <= lone.keys() and not {2, 41} & lone.keys()
    assert clean.keys() == lone.keys() - {42}
    assert KEY not in masked[43] and masked[8] == LONG
    tokens = corpus_pipeline.tokenized(spark, kept[-1], sf_dir).collect()
    assert len(tokens) == kept[-1].count() and all(r["lossless"] for r in tokens)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, tokens))


def test_empty_tables(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, sf_dir).collect() == []


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert names.keys() >= queries.QUERIES.keys() | {"pipeline"}
    assert __spark_entry__.oracle_sql().keys() <= names.keys()
