"""Every operator on nulls, empty and very long texts, ties, repeats, empty tables and clashing names."""

import public_tokenizers
import pytest
from fixtures import ODD, docs, words
from pyspark.sql import functions as F

from threadloom.llm.decontam import contamination
from threadloom.llm.licenses import scan_licenses
from threadloom.llm.pii import find_spans
from threadloom.llm.quality import score_quality
from threadloom.llm.repeats import remove_repeats
from threadloom.llm.sentencepieces import encode_decode
from threadloom.llm.simhash import near_duplicates
from threadloom.llm.topk import top_k
from threadloom.llm.toxicity import score_toxicity
from threadloom.llm.warc import archive_round_trip

LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 0, 1), (4, 0, 1), (5, 1, None), (None, 1, 1), (8, 0, 0), (8, 1, 0), (9, 1, 1)], LABELS)


def bench(spark):
    return spark.createDataFrame([(1, "word"), (2, None), (None, "hello there"), (3, ""), (1, "word")], "item_id long, text string")


OPERATORS = {
    "licenses": lambda s, d: scan_licenses(d),
    "pii": lambda s, d: find_spans(d),
    "simhash": lambda s, d: near_duplicates(d),
    "decontam": lambda s, d: contamination(d, bench(s)),
    "quality": lambda s, d: score_quality(d, labels(s)),
    "toxicity": lambda s, d: score_toxicity(d, labels(s)),
    "pieces": lambda s, d: encode_decode(d, public_tokenizers.path("piece_bpe_32k.model")),
    "repeats": lambda s, d: remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_each_and_none_of_an_empty_table(spark, name):
    odd = docs(spark)
    found = OPERATORS[name](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in ODD)
    same = {}
    for r in found:  # repeated rows get equal results
        same.setdefault(r.doc_id, set()).add(repr(r))
    assert all(len(v) == 1 for v in same.values())
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


def test_simhash_of_odd_rows(spark):
    found = {r.doc_id: r for r in near_duplicates(docs(spark)).collect()}
    # Texts without words have fingerprint 0 and are one component.
    assert [found[i].fp for i in (1, 2, 6)] == [0, 0, 0]
    assert {found[i].component_id for i in (1, 2, 6)} == {1}
    assert found[None].component_id is None


def test_decontamination_of_odd_rows(spark):
    found = {r.doc_id: r for r in contamination(docs(spark), bench(spark)).collect()}
    assert (found[3].n_hit, found[3]["items"], found[3].contaminated) == (1, [1], True)
    assert (found[None].n_hit, found[None]["items"], found[None].contaminated) == (2, [], True)
    assert (found[1].n_words, found[1].n_hit, found[1].contaminated) == (0, 0, False)
    assert contamination(docs(spark), bench(spark).limit(0)).filter("contaminated").count() == 0


def test_licenses_of_odd_rows(spark):
    found = {r.doc_id: r for r in scan_licenses(docs(spark)).collect()}
    assert (found[9].n_base, found[9].first_word, found[9].last_word, found[9].base_labels, found[9].score) == (2, 0, 2, ["mit"], 1.0)
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].labels, found[1].score) == (0, 0, None, [], 0.0)
    assert {i: r.n_words for i, r in found.items()} == {i: len(words(t)) for i, t in ODD}


def test_repeats_of_odd_rows(spark):
    found = {r.doc_id: r for r in remove_repeats(docs(spark)).collect()}
    assert found[7].kept == b"" and [tuple(s) for s in found[7].spans] == [(0, 5_000)]  # one letter repeats itself
    assert found[8].kept == b"" and found[4].spans == [] and found[1].data == b"" and found[3].kept == b"word"


def test_held_out_rows_and_scores(spark):
    for name, fn in (("quality", score_quality), ("toxicity", score_toxicity)):
        rows = fn(docs(spark), labels(spark)).collect()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows), name
        assert not next(r for r in rows if r.doc_id is None).held_out
        none = fn(docs(spark), labels(spark).limit(0)).collect()
        assert all(0 <= r.score <= 1 for r in none), name


def test_vectors(spark):
    rows = [(0, [0.5, 0.5]), (50, [0.25, -0.5]), (7, [0.5, 0.5]), (8, [0.5, 0.5]), (9, None), (10, [None, 1.0]), (11, [float("nan"), 1.0]),
            (12, [float("inf"), 0.0]), (None, [1.0, 1.0]), (13, [1.0]), (14, []), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    got = [tuple(r) for r in top_k(df, k=3).orderBy("query_id", "rank").collect()]
    full = 128 * 128 * 2
    assert got == [(0, 1, 7, full), (0, 2, 7, full), (0, 3, 8, full), (50, 1, 0, -8192), (50, 2, 7, -8192), (50, 3, 7, -8192)]
    assert top_k(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a/\r\nX: y", None), (2, None, ""), (3, "http://é/", "<p>ü</p>"), (3, "http://é/", "<p>ü</p>"), (4, "u", "<p>ü</p>"),
            (None, "n", "<p>ü</p>"), (None, "m", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("page", F.lit("x"))
    for split in (64, 1 << 20):
        got = archive_round_trip(df, split_bytes=split).collect()
        kinds = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
        assert kinds == sorted([("1", "revisit", 2, 0), ("2", "response", None, 0), ("3", "revisit", 4, 9), ("3", "revisit", 4, 9),
                                ("4", "response", None, 9), ("None", "revisit", 4, 9), ("None", "response", None, 5)])
        urls = {r.url for r in got}
        assert urls == {"http://a/\r\nX: y", None, "http://é/", "u", "n", "m"}
    assert archive_round_trip(df.limit(0)).count() == 0
