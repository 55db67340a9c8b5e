"""The decontamination stage of the pipeline fits its latent space on all documents that reach it."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from inkspark.llm import decontaminate
from inkspark.llm.words import word_hashes


def test_the_stage_fits_on_all_documents(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"d{i}x{k}" for k in range(4)) for i in range(5000)]
    item = " ".join(f"i{k}" for k in range(30))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate([*texts, item])), "doc_id long, text string")
    fitted, fit = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == set(range(5000))
    seen = np.unique(decontaminate._buckets(word_hashes(pa.array(texts))[1]))
    assert len(fitted) == 1 and (np.abs(fitted[0][0][seen]).max(axis=1) > 0).all()
