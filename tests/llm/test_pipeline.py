"""The pipeline's stages against the brute-force versions of the operators' tests."""

import corpus_pipeline
from pyspark.sql import functions as F

from framefold.llm.common import table
from tests.llm.conftest import odd_rows
from tests.llm.test_near_dedup import brute as linked
from tests.llm.test_packing import encode
from tests.llm.test_substring_dedup import brute as repeated

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, SF)
    left = {r["doc_id"] for r in clean.collect()}
    toxic = {i for i, r in labels.items() if r["toxic"] == 1}
    assert clean.columns == docs.columns and len(toxic & left) <= 0.2 * len(toxic) and len(left) > 0.7 * docs.count()
    good = stage["quality rules"](spark, docs, SF)
    kept = {r["doc_id"] for r in good.collect()}
    fine = {i for i, r in labels.items() if r["quality"] == 1}
    assert good.columns == docs.columns and len(fine & kept) > 0.9 * len(fine)
    single = stage["near duplicates"](spark, docs, SF)
    rows = pairs(docs)
    components = linked(rows, 5, 80)
    assert single.columns == docs.columns and pairs(single) == [(i, t) for i, t in rows if components[i] == i]
    cut = stage["repeated passages"](spark, docs, SF)
    want = {i: " ".join(words) if n != len(words) else None for i, (n, words) in repeated(rows).items()}
    assert cut.columns == docs.columns and pairs(cut) == [(i, t if want[i] is None else want[i]) for i, t in rows]
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if want[r["doc_id"]] is not None)
    pieces = stage["packing"](spark, docs, SF).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(ids) + 1 for (i, _), ids in zip(rows, encode([t for _, t in rows]))}


def test_odd_rows(spark, odd, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and stage(spark, no_docs, SF).collect() == [], name
    single = corpus_pipeline.drop_near_duplicates(spark, odd, SF).collect()
    assert [r["doc_id"] for r in single].count(16) == 1 and [r["doc_id"] for r in single].count(None) == 2
    assert sum(r["doc_id"] in (1, 2, 3) for r in single) == 1
    assert corpus_pipeline.pack_sequences(spark, no_docs, SF).collect() == []
    assert corpus_pipeline.drop_repeated_passages(spark, odd, SF).count() == len(odd_rows())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_columns_of_any_name_and_kind(spark):
    """A column named like the stages' own, and a map beside a repeated doc_id."""
    shared = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "alpha beta " + shared, 1, {"a": 1}), (2, "gamma delta " + shared, 2, {"b": 2}), (3, shared[::-1], 3, None), (3, shared[::-1], 4, {"c": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, `odd.name` map<string,int>").withColumn("kept_text", F.lit("x"))
    cut = corpus_pipeline.drop_repeated_passages(spark, docs, SF)
    assert cut.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["_kept"]) for r in cut.collect()} == {(1, rows[0][1], 1), (2, "gamma delta", 2), (3, rows[2][1], 3), (3, rows[3][1], 4)}
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) in ([1, 2, 3], [1, 3])
