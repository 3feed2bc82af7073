"""The queries of documents read every stored document with its own text."""

import pytest

from textloom.plans import queries as Q

PER_DOCUMENT = "detect_verdict token_stats finding_counts clean_text tell_scrub thousands model_score merged_spans".split()


def test_every_document_text(spark, sf_dir):
    stored = {(r["doc_id"], r["text"]) for r in Q.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = Q.whole(spark, sf_dir).collect()
    assert stored == {(r["doc_id"], r["text"]) for r in rows if r["doc_id"] >= 0}
    assert len(rows) == 2 * len(stored) and len({r["doc_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_no_document_is_left_out(spark, sf_dir, name):
    ids = [r["doc_id"] for r in Q.queries()[name](spark, sf_dir).select("doc_id").filter("doc_id >= 0").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in Q.table(spark, sf_dir, "documents").select("doc_id").collect())
