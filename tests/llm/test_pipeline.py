import sys

import pytest
from fixtures import documents

import corpus_pipeline
from tidemark.llm import queries as registered


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    rows = [r[:5] for r in documents() if r[0] is not None]
    item = rows[30][1]
    rows.append((900, " ".join(f"before{k}" for k in range(60)) + " " + " ".join(f"item{k}" for k in range(20)) + " after", "en", "s", 1))
    rows.append((901, " ".join(f"u{k}" for k in range(80)) + " password=0123456789abcdef0", "en", "s", 1))
    assert item
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20)))], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, folder):
    docs = start = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs.cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == start.columns
        docs = seen[name]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert all(len((r.text or "").split()) >= 50 for r in seen["quality_rules"].collect())
    assert ids["jaccard_join"] < ids["quality_rules"]
    assert ids["jaccard_join"] - ids["decontamination"] == {900}
    assert ids["secret_scans"] == ids["decontamination"]
    assert [r.text[-9:] for r in seen["secret_scans"].filter("doc_id = 901").collect()] == [" [secret]"]
    last = seen["sentencepiece"].collect()
    assert {r.doc_id for r in last} == ids["secret_scans"] and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.ids) for r in whole.collect()) == sorted((r.doc_id, r.ids) for r in last)


def test_names():
    assert [int(k[2:].split("_")[0]) for k in registered.queries()] == list(range(1, 1 + len(registered.queries())))
    assert "corpus_pipeline" in sys.modules
