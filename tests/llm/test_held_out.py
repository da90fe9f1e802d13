"""Toxicity (7) on labelled documents that the chain wasn't fitted on."""

import zlib

import pytest
from pyspark.sql import functions as F

from tanpura.llm import queries, toxicity


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_toxicity_of_unseen_texts(spark, folder):
    """A third of the labelled rows is held out, without those whose text is among the others: 109 of 137 toxic ones were found when this was written, and none wrongly."""
    docs, labels = (queries.table(spark, folder, t) for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    assert spark.range(1).select(F.crc32(F.lit("12").cast("binary"))).first()[0] == zlib.crc32(b"12")
    chain = toxicity.fit_chain(docs.select("doc_id", "text"), queries.toxic_categories(labels.where(~out)), queries.TOXIC)
    seen = docs.join(labels.where(~out), "doc_id").select("text")
    rated = toxicity.toxicity(docs.join(labels.where(out).select("doc_id"), "doc_id").join(seen, "text", "left_anti").select("doc_id", "text"), chain)
    both = rated.withColumnRenamed("toxic", "said").join(labels, "doc_id").select("said", "toxic").collect()
    toxic = [r for r in both if r["toxic"]]
    found, wrong = sum(r["said"] for r in toxic), sum(r["said"] for r in both if not r["toxic"])
    print(f"held out {len(both)}, toxic {len(toxic)}, found {found}, wrong {wrong}")
    assert len(toxic) >= 100 and found >= 0.75 * len(toxic) and wrong <= 0.01 * len(both)
