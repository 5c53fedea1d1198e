"""The pipeline on a small input: stages keep the columns and the clean documents."""

from __future__ import annotations

import corpus_pipeline
from tonelake.llm import common, stages

SF_DIR = "/root/testdata/sf0.01"  # large enough to learn from


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF_DIR}/labels.parquet")
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    left = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name.replace(" ", "_"))
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= left
        if name == "toxicity":
            assert len(now & toxic) <= 0.2 * len(toxic) and len(now & clean) >= 0.93 * len(clean)
        if name == "line dedup":
            assert now == left
        left = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


def test_near_copies_by_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(98)]
    near = ["other" if i in (30, 60) else w for i, w in enumerate(words)]
    # 84 of 104 five-word shingles are common, and 87 of 103 four-word ones: 0.808 and 0.845.
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "quite another text of some words")]
    for size, share in ((5, 0.8), (4, 0.85)):
        a, b = ({tuple(x[i : i + size]) for i in range(len(x) - size + 1)} for x in (words, near))
        assert (len(a & b) / len(a | b) >= share) == (size == 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in stages.one_of_each_group(spark, docs, "").collect()} == {1, 3}


def exchanged(df, column):
    """Rows that the exchanges of an ended query wrote with this column."""
    left, rows = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in name:
            left.append(node.plan())
        left += [node.children().apply(i) for i in range(node.children().size())]
        if name == "Exchange" and f"{column}#" in node.output().toString():
            rows += node.metrics().apply("shuffleRecordsWritten").value()
    return rows


def test_only_documents_with_passages_are_shuffled(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"text number {i} of many") for i in range(400)]
    rows += [(500, f"see {item} there"), (7, item), (None, item), (None, "no id"), (8, "once more"), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # As on large tables, where the ids are too many to broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stages.drop_contaminated(spark, docs, str(tmp_path))
        left = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(left, key=str) == sorted([r for r in docs.collect() if r.doc_id not in (7, 500)], key=str)
    assert exchanged(out, "text") <= 10


def test_rows_without_ids_with_crowded_bit_maps(spark):
    rows = spark.range(500).selectExpr("if(id % 50 = 0, null, id % 300) as doc_id", "id as other")
    ids = spark.range(90).selectExpr("if(id = 0, null, id * 3) as doc_id")
    want = sorted(rows.join(ids, "doc_id", "left_anti").select("doc_id", "other").collect(), key=str)
    for bits in (6, 7, 24):
        assert sorted(common.without_ids(rows, ids, "doc_id", bits).collect(), key=str) == want
    none = ids.where("doc_id < 0")
    assert common.without_ids(rows, none, "doc_id").count() == 500
