"""Every operator on tables whose further columns are named like the columns it uses inside; labels of equal rows."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import bpe, decontaminate, language, line_dedup, periodic, quality, quality_rules, shingle_join, simhash, suffix_dedup, token_count, top_k, toxicity, whitening
from lumaframe.llm.queries import PIECES, TOKENIZER

INSIDE = """
    sig n keys body key size at i hub degree a b x y l share known kind slot uid id asks pivot near shard block rows ids scores v runs collapsed root component
    node fp words label learn score predicted held_out line pos k r part sum _id _body n_tokens decoded item_id bucket gram stretch several hash start length period
    count low high least shared more all own first offers item words_in held level run found toxic quality lang_pred _dropped _n_lines _kept twins other rank hit
""".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"some words of text number {k % 7}\nand a line that all share\nthen {k}", "en" if k % 2 else "de", "s", 9) for k in range(30)] + [(None, None, None, None, None), (99, "", None, "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("z").alias(c) for c in INSIDE]).cache()


def test_documents(docs, spark):
    n = docs.count()
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, label int")
    bench = spark.createDataFrame([(1, "some words of text number 3")], "item_id long, text string").select("*", *[F.lit("z").alias(c) for c in INSIDE if c != "item_id"])
    whole = docs.drop("label", "learn")
    assert quality.classify(whole, labels, F.col("doc_id") > 5).count() == n
    assert toxicity.scored(docs, toxicity.fit(docs, labels)).count() == n
    assert language.predicted(docs, language.fit(docs)).count() == n
    assert suffix_dedup.without_repeats(docs, length=40, digest=True).count() == n
    assert line_dedup.clean(docs, min_docs=10, min_chars=1).columns == docs.columns
    assert quality_rules.judged(docs).count() == n
    assert simhash.near_groups(docs, shingle=3, max_bits=2).count() == n
    assert shingle_join.near_groups(docs).count() == n and shingle_join.near_groups(docs.where("false")).count() == 0
    assert token_count.token_counts(docs, PIECES).count() == n
    assert bpe.encoded(docs, TOKENIZER, digests=True).count() == n
    assert decontaminate.contaminated(docs, bench).count() > 0
    assert periodic.periodic_runs(docs).count() == n
    assert toxicity.clean(docs, toxicity.fit(docs, labels)).columns == docs.columns


def test_stage(docs, spark):
    assert corpus_pipeline.one_of_each_group(spark, docs, "").columns == docs.columns


def test_vectors(spark):
    rows = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k)]) for k in range(20)], "vec_id long, embedding array<double>").select("*", *[F.lit("z").alias(c) for c in [*INSIDE, "deviation", "whitened"]])
    assert whitening.components(rows).count() == 40
    assert top_k.top_k(rows, F.col("vec_id") % 10 == 0, k=3).count() == 6


@pytest.mark.parametrize("other", [None, "quite another text, with other words"])
def test_labels_of_equal_rows(spark, other):
    text = "the same text for every row of a class"
    docs = spark.createDataFrame([(k, (other or text) if k % 2 else text) for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, label int")
    found = quality.classify(docs, labels, F.col("doc_id") < 70).toPandas()
    assert len(found) == 80 and found.score.between(0, 1).all() and found.score.nunique() == (2 if other else 1)
    if other:
        assert (found.predicted == found.doc_id % 2).all()
