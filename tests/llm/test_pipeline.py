import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from lumaframe.llm.queries import TOKENIZER

from .conftest import SCHEMA, odd_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    item = "one quite particular benchmark question about the height of the third tower in the old harbor town"
    rows = [*odd_rows(), *[(900 + k, f"Some words first {k}. {item} and some after", "en", "s", None, 1.0, "", "", "", 0) for k in range(3)]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_the_columns_and_the_clean(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), folder).count() == 0
        docs = out
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {900, 901, 902} and not ids & set(range(100, 112)) and set(range(5, 40)) <= ids


def test_run(spark, folder):
    library = Tokenizer.from_file(TOKENIZER)
    for r in corpus_pipeline.run(spark, folder).collect():
        assert r["n_tokens"] == len(r["ids"]) and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
