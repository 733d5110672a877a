import corpus_pipeline
import pyarrow as pa
from test_simhash import slow_groups
from wayfowl.llm import packing, quality, toxicity
from wayfowl.llm.common import table, written

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    columns, rows = docs.columns, {r.doc_id: r.text.encode() for r in docs.collect()}
    model = toxicity.train(docs, labels)
    clean = {i for i, t in rows.items() if model.score(t) < toxicity.THRESHOLD}
    step = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert step.columns == columns and {r.doc_id for r in step.select("doc_id").collect()} == clean
    kept = docs.where(docs.doc_id.isin(list(clean)))
    model = quality.train(kept, labels)
    good = {i for i in clean if model.score(rows[i]) >= quality.THRESHOLD}
    step = corpus_pipeline.keep_quality(spark, kept, SF)
    assert step.columns == columns and {r.doc_id for r in step.select("doc_id").collect()} == good
    kept = docs.where(docs.doc_id.isin(list(good)))
    left = set(slow_groups({i: rows[i].decode() for i in good}).values())
    step = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    assert step.columns == columns and {r.doc_id for r in step.select("doc_id").collect()} == left
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == left
    assert packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    odd = [(None, None), (None, "a b c"), (-1, None), (-2, ""), (-3, "word " * 100_000), (-4, "twice told " * 20), (-4, "twice told " * 20), (-4, "another text under one id " * 9)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("doc_id", "text", "1 AS score", "'x' AS row", "2 AS predicted", "3 AS node", "4 AS piece")
    both.write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (-1, None, None)], labels.schema)).write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts = table(spark, str(tmp_path), "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, docs, str(tmp_path))
        assert step.schema == docs.schema
        docs = spark.createDataFrame(step.collect(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] <= 1008
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    want = {r.doc_id for r in docs.collect()}
    assert set(packed.doc_id.dropna().astype(int)) == {i for i in want if i is not None} and packed.doc_id.isna().any() == (None in want)


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_packing_leaves_nothing_in_the_workers_of_the_next_run(spark):
    """Objects of packing's that Python workers hold in a task of their own, after packing and after each stage of another run."""

    def held(batches):
        import gc

        n = sum(type(o).__name__ == "WordTokens" for o in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    def most():
        return max(r.n for r in spark.range(16).repartition(16).mapInArrow(held, "n long").collect())

    docs = written(table(spark, SF, "documents").select("doc_id", "text").limit(300).repartition(16))
    first = corpus_pipeline.pack(spark, docs, SF).toPandas()
    assert most() > 0  # a later task of packing finds what was learnt
    for _, stage in corpus_pipeline.STAGES[:-1]:
        corpus_pipeline.pack(spark, docs, SF).count()
        stage(spark, docs, SF).collect()
        assert most() == 0
    again = corpus_pipeline.pack(spark, docs, SF).toPandas()
    by = ["doc_id", "piece"]
    assert first.sort_values(by)[["doc_id", "length", "ids_crc32"]].values.tolist() == again.sort_values(by)[["doc_id", "length", "ids_crc32"]].values.tolist()
