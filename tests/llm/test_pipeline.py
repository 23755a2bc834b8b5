"""The pipeline, stage by stage, against brute force; each stage on its predecessor's own output."""

import corpus_pipeline
import pytest
from cases import SMALL, empty, given, odd
from test_decontaminate import brute as brute_leaks
from test_lines import brute as brute_lines
from test_packing import check as check_packing
from test_simhash import brute_classes, brute_print

from apexline.llm import language


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], SMALL).write.parquet(f"{folder}/{name}")
        found.append(spark.read.parquet(f"{folder}/{name}"))
    return found


def test_columns(outputs):
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "lines", "near_duplicates", "decontamination", "packing",
    ]


def test_language(spark, outputs):
    before, after = outputs[0], {r.doc_id for r in outputs[1].collect()}
    found = {r.doc_id: r for r in language.identify(before, language.learn(before)).collect()}
    assert after == {i for i, r in found.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.MIN_SCORE}
    assert len(after) > 0.95 * before.count()


def test_lines(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[1].collect()]
    removed = brute_lines(rows)
    want = {i: "\n".join(s for n, s in enumerate(t.split("\n")) if n not in removed.get(i, ())) for i, t in rows}
    assert {r.doc_id: r.text for r in outputs[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in outputs[2].collect())


def test_near_duplicates(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[2].collect()]
    classes = brute_classes([(i, brute_print(t)) for i, t in rows])
    assert sorted(r.doc_id for r in outputs[3].collect()) == sorted({c for _, _, c in classes})


def test_decontamination(outputs):
    rows = [(r.doc_id, r.text) for r in outputs[3].collect()]
    leaks = brute_leaks(rows, given("benchmark", columns="item_id, text"))
    assert {r.doc_id for r in outputs[4].collect()} == {i for i, _ in rows} - {i for i, _ in leaks}


def test_packing(outputs):
    check_packing(outputs[5].collect(), [(r.doc_id, r.text) for r in outputs[4].collect()])


def test_run_gives_the_last_stage(spark, outputs):
    got = corpus_pipeline.run(spark, SMALL)
    pieces = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0)
    assert pieces(got) == pieces(outputs[-1])


def test_odd_and_empty_tables(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd(spark), empty(spark)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{name}-{table.count()}"
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
            if name != "packing":
                assert docs.columns == table.columns
