"""The pipeline, stage by stage, against brute force on the smallest documents and on rows written by hand."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brickwork.llm import quality_classifier, secret_scan
from brickwork.llm.common import written
from tests.llm.test_groups import brute_groups

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9004, 'That the thing was token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and then with the other.', "en", "s", 90), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "12 34 !!", "de", "s", 8), (9003, "12 34 !!", "de", "s", 8), (None, "The thing that was with the other one and then more of it.", None, None, None)]
    return written(base.unionByName(spark.createDataFrame(odd, base.schema)), "test-docs")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "secret scans", "best-fit packing"]


def test_language_keeps_clean_documents(spark, docs):
    out = STAGE["language ID"](spark, docs, SF)
    assert out.schema == docs.schema
    kept = rows(out)
    assert [r for r in rows(docs) if r not in kept] == sorted([r for r in rows(docs) if r[0] in (9001, 9002, 9003)], key=repr)


def test_quality_follows_the_score(spark, docs):
    out = STAGE["quality classifier"](spark, docs, SF)
    assert out.schema == docs.schema
    model = quality_classifier.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score(np.array([quality_classifier.statistics(r[1]) for r in rows(docs)]))
    assert rows(out) == [r for r, s in zip(rows(docs), score) if s >= 0.3]
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r[0] for r in rows(out)}
    assert np.mean([(i in left) == bool(q) for i, q in truth.items()]) > 0.95


def test_near_copies_leave_one(spark, docs):
    out = STAGE["MinHash near-dedup"](spark, docs, SF)
    assert out.schema == docs.schema
    groups = brute_groups([(r[0], r[1]) for r in rows(docs) if r[0] is not None], 5, 80)
    assert rows(out) == [r for r in rows(docs.distinct()) if r[0] is None or groups[r[0]][2]]


def test_secrets_are_replaced(spark, docs):
    out = STAGE["secret scans"](spark, docs, SF)
    assert out.schema == docs.schema and out.count() == docs.count()
    costs = secret_scan.GuessCost()

    def redacted(text):
        base = secret_scan.base_spans(text or "")
        return secret_scan.redact(text, secret_scan.spans_text(sorted(base + secret_scan.guess_spans(text or "", base, costs, 10.0)[0])))

    def expected(r):
        text = redacted(r[1])
        return (r[0], text, *r[2:4], None if text is None else len(text))

    assert rows(out) == sorted(map(expected, rows(docs)), key=repr)
    assert any("[SECRET]" in (r[1] or "") for r in rows(out))


def test_run_packs_all_that_is_kept(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), "test-stage")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.collect()}
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == tokens
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_of_an_empty_table(spark, docs, name):
    out = STAGE[name](spark, docs.limit(0), SF)
    assert out.count() == 0 and (name == "best-fit packing" or out.schema == docs.schema)


@pytest.mark.parametrize("name", list(STAGE)[:-1])
def test_other_columns_pass_whatever_their_names(spark, docs, name):
    more = {"lang_pred": F.lit("x"), "lang_score": F.lit(1.5), "quality_score": F.lit(None).cast("int"), "redacted": F.col("doc_id"), "s_n_words": F.lit(3), "component_id": F.lit("c"), "id": F.lit(9), "kept": F.lit(False)}
    few = docs.where("doc_id IS NULL OR doc_id % 3 = 0")
    wide = STAGE[name](spark, written(few.withColumns(more), "wide"), SF)
    assert wide.columns == docs.columns + list(more)
    assert rows(wide.select(docs.columns)) == rows(STAGE[name](spark, few, SF))


def test_margin_for_any_number_of_languages(spark, docs):
    two = docs.where("lang IN ('en', 'de') AND length(text) > 40")
    short = spark.createDataFrame([(70001, "the thing that was with the other", "en", "s", 30), (70002, "½ ² ①", "en", "s", 5)], docs.schema)
    kept = {r.doc_id for r in STAGE["language ID"](spark, two.unionByName(short), SF).select("doc_id").collect()}
    assert 70001 in kept and 70002 not in kept and len(kept) > 0.98 * two.select("doc_id").distinct().count()
