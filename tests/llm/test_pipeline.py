import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from treeline.llm import pieces, queries  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, documents, prose):
    at = tmp_path_factory.mktemp("corpus")
    passage = prose(40, 1)
    rows = [(k, prose(80, 100 + k), f"s{k % 8}") for k in range(60)]
    rows += [(100 + k, prose(40, 300 + k) + " scumbag idiocy " + prose(40, 400 + k), "s1") for k in range(30)]
    rows += [(200, prose(30, 500) + " " + passage, "s2"), (201, rows[0][1] + " more", "s3"), (202, None, "s4"), (203, "", None)]
    rows += [(300 + k, "the boilerplate line of many sites\n" + prose(60, 600 + k), f"s{k}") for k in range(8)]
    rows += [(None, prose(50, 700), "s1")]
    documents(rows).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 1) for k in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_take_effect(spark, folder):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {*range(60), 202, 203, *range(300, 308), None}
    assert [k for k in range(300, 308) if out[k].text.startswith("the boilerplate")] == [300]
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text is not None)
    assert out[202]["ids"] is None and out[203]["ids"] == [] and out[5].n_tokens == len(out[5]["ids"]) > 0


def test_columns_named_like_those_of_the_last_stage(spark, folder, tmp_path):
    clashing = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'mine' AS ids", "7 AS N_Tokens", "1 AS decoded")
    out = corpus_pipeline.tokenize(spark, clashing, folder)
    assert out.columns.count("ids") == 1 and "N_Tokens" not in out.columns and dict(out.dtypes)["ids"] == "array<int>"
    back = pieces.decode(out.where("doc_id = 5"))
    row = back.first()
    assert back.columns.count("decoded") == 1 and row.decoded == row.text


def test_empty_tables(spark, folder, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
