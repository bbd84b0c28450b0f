"""The pipeline's stages, each against what its operator says of its own input."""

import hashlib

import pytest
import sentencepiece
from fixtures import ODD, SF, docs, long_text
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import queries
from threadloom.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and the last result."""
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF), name))
    return tables


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    assert all(t.columns == COLUMNS for t in stages[:-1])


def test_rejected_documents_go(spark, stages):
    good = queries.op6_quality(spark, SF).filter("predicted = 1")
    assert ids(stages[1]) == ids(good)


def test_one_of_each_group_stays(spark, stages):
    found = queries.near_duplicates(stages[1])
    assert ids(stages[2]) == sorted({r.component_id for r in found.collect()})


def test_contaminated_documents_go(spark, stages):
    found = queries.contamination(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(stages[3]) == ids(found.filter("not contaminated")) and found.filter("contaminated").count() > 0


def test_personal_data_goes(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    left = queries.find_spans(stages[4]).filter(F.size("base") > 0).count()
    assert left == 0 and any(r.text != before[i].text for i, r in after.items())
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)


def test_tokens_of_what_is_left(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    text = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        coded = library.encode(text[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, coded)).encode()).hexdigest()


def test_run_is_all_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_odd_rows_pass_every_stage(spark):
    odd = docs(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, SF)
        assert found.count() <= len(ODD) and stage(spark, odd.limit(0), SF).count() == 0


def test_decisions_hold_when_files_are_cut_otherwise(spark, tmp_path, monkeypatch):
    """A second read may be cut into other partitions, as after the loss of an executor."""
    path = str(tmp_path / "docs")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12, "doc_id").write.parquet(path)
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before, waiting = {k: spark.conf.get(k) for k in (size, cost)}, corpus_pipeline._decided

    def cut_anew(rows):
        decided = waiting(rows)
        spark.conf.set(size, "64m")
        spark.conf.set(cost, "0")
        return decided

    for name, stage in corpus_pipeline.STAGES[:1]:
        want = sorted(map(tuple, stage(spark, spark.read.parquet(path), SF).collect()))
        monkeypatch.setattr(corpus_pipeline, "_decided", cut_anew)
        try:
            spark.conf.set(size, "8k")
            spark.conf.set(cost, "4k")
            got = sorted(map(tuple, stage(spark, spark.read.parquet(path), SF).collect()))
        finally:
            monkeypatch.setattr(corpus_pipeline, "_decided", waiting)
            for k, v in before.items():
                spark.conf.set(k, v)
        assert got == want, name


def test_equal_rows_leave_one(spark):
    rows = [(3, "same words here"), (3, "same words here"), (None, "none has an id"), (None, "none has an id"), (4, "same words here")]
    found = corpus_pipeline.near_duplicate(spark, docs(spark, rows), SF)
    assert sorted(map(str, ids_of(found))) == ["3", "None"]


def test_one_id_on_unlinked_texts(spark):
    far = [long_text(60, seed) for seed in (1, 2, 3)]
    near = long_text(400, 4)
    rows = [(1, far[0]), (1, far[1]), (2, far[1]), (1, far[2]), (None, near), (None, near + " end")]
    linked = {r.component for r in corpus_pipeline.near_duplicates(docs(spark, rows[4:])).collect()}
    found = corpus_pipeline.near_duplicate(spark, docs(spark, rows), SF).collect()
    assert len(linked) == 1 and sorted(r.text for r in found if r.doc_id == 1) == sorted(far)
    assert len(found) == 4


def ids_of(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns_of_the_names_that_stages_add(spark):
    names = (corpus_pipeline._KEY, corpus_pipeline._SPANS)
    rows = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, rows, SF)
        assert found.columns == rows.columns, name
        assert found.filter(" OR ".join(f"{c} != concat('{c}', doc_id)" for c in names)).count() == 0
