"""Each stage on what its predecessor kept, against what its operator decides."""

from collections import Counter

import pytest

import corpus_pipeline
from basketlens.llm import mixing, toxicity
from basketlens.llm.common import read, saved
from tests.conftest import SF001
from tests.llm.test_simhash import component_ids


@pytest.fixture(scope="module")
def steps(spark):
    docs = read(spark, SF001, "documents").withColumnRenamed("n_chars", "n_chars")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF001), f"test-{name}")
        out.append(docs)
    return out


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pii", "mix", "pack"]


def test_columns_of_documents_are_kept(steps):
    for frame in steps[1:-1]:
        assert frame.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark, steps):
    wanted = toxicity.classify(steps[0], read(spark, SF001, "labels")).filter("predicted = 0")
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(r.doc_id for r in wanted.collect())


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(component_ids(rows))


def test_pii_keeps_all_documents(steps):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in steps[2:4])
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]]
    assert changed and all(any(c.isdigit() for c in before[i]) for i in changed)


def test_documents_repeat_as_mixed(steps):
    copies = {r.doc_id: r.copies for r in mixing.mix(steps[3]).collect()}
    assert Counter(r.doc_id for r in steps[4].collect()) == Counter({d: n for d, n in copies.items() if n})


def test_every_mixed_document_is_packed(steps):
    packed = Counter(r.doc_id for r in steps[5].collect() if r.piece == 0)
    assert packed == Counter(r.doc_id for r in steps[4].collect())


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "w " * 60_000, "en", None, 1), (2, "w " * 60_000, "en", None, 1), (3, "x 4067045560024629", "en", "a", 2)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, SF001), "edge")
        assert (docs.count() > 0) == bool(rows)
