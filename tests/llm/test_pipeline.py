import corpus_pipeline
from pyspark.sql import functions as F
from pairloom.llm import queries
from pairloom.llm.common import stored
from test_texts import ODD, SCHEMA, made


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.createDataFrame([r for r in made(40) + ODD if r[0] is not None and r[0] != 904], SCHEMA)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, ""))
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
        sizes.append(out.count())
    assert sizes[1] == sizes[0] - 4  # the four texts without a letter
    assert sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()


def test_thirteen_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


CLASHES = ["_held", "_out", "_twice", "held", "out", "twice", "key", "row", "node", "size", "shard", "a.b"]


def test_clashing_names_null_ids_and_repeats_pass_all_stages_but_the_last(spark):
    """A null id is one as any other; the two rows of id 905 are one."""
    docs = spark.createDataFrame([r for r in made(20) + ODD if r[0] != 904], SCHEMA).withColumns({c: F.lit(f"is {c}") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""))
        assert docs.columns[-len(CLASHES) :] == CLASHES
        first = docs.first()
        assert all(first[c] == f"is {c}" for c in CLASHES)
        if name == "near_copies":
            assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id = 905").count() == 1
    assert stored(corpus_pipeline.STAGES[-1][1](spark, docs, "")).count() >= docs.count()


def test_empty_table_goes_through_and_settings_stay(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(n, None) for n in names]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [spark.conf.get(n, None) for n in names] == before
