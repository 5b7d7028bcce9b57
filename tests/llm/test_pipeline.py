"""The pipeline on a small folder of tables, stage by stage, against what each stage has to do."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from tests.llm.test_operators import corpus, prose, split


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    bad = ["vile", "scum", "filth"]
    toxic = [(1000 + i, prose(rng, 40) + " " + " ".join(rng.choice(bad) for _ in range(6))) for i in range(40)]
    clean = [(2000 + i, prose(rng, 60)) for i in range(300)]
    rows = [(i, t, "en", "src", 1, "x") for i, t in [*corpus(), *toxic, *clean]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __nth string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in toxic[:30]] + [(i, 0) for i in [*range(40), *range(2000, 2200)]], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, " ".join(split(corpus()[30][1])[:50]))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        kept[name] = [r.doc_id for r in docs.collect()]
        if k < 4:
            assert docs.columns == columns
    assert not [i for i in kept["toxicity"] if i is not None and 1000 <= i < 2000]
    assert len(kept["toxicity"]) == len(corpus()) + 300
    once = kept["exact dedup"]
    assert not set(once) & {100, 101, 104, 110, 404} and once.count(3) == 1 and once.count(4) == 2 and once.count(None) == 1 and 400 in once
    near = kept["n-gram Jaccard join"]
    assert not set(near) & set(range(200, 208)) and set(range(40)) <= set(near) and {300, 305, 400, 401, 405, 500} <= set(near)
    clean = kept["benchmark decontamination"]
    assert set(near) - set(clean) == {30}
    assert set(kept["best-fit packing"]) == set(clean)
    assert corpus_pipeline.run(spark, folder).count() == len(kept["best-fit packing"])


def test_stages_on_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).count() == 0
