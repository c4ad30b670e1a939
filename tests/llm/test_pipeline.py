"""The corpus pipeline, stage by stage, on the smallest tables."""

import re

import corpus_pipeline as cp
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert out.columns == columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        seen[name], docs = (docs, out), out
    before, after = seen["decontamination"]
    gone = before.join(after, "doc_id", "left_anti")
    assert after.count() + gone.count() == before.count()
    before, after = seen["near_duplicates"]
    sets = {r["doc_id"]: r["text"].split() for r in after.collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in sets.items()}
    ids = sorted(grams)
    assert not any(grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]) for a in ids for b in ids if a < b)
    for r in seen["secrets"][1].collect():
        assert not re.search(r"[0-9a-f]{24,}", r["text"]) and r["n_chars"] == len(r["text"])
    mixed = seen["mixing"][1]
    assert mixed.count() == seen["secrets"][1].count()
    assert mixed.where("taken > 3 * size").count() == 0
    ran = cp.run(spark, DATA)
    assert sorted(map(str, ran.collect())) == sorted(map(str, mixed.collect()))
    assert abs(mixed.agg(F.sum("taken")).first()[0] - mixed.agg(F.sum("size")).first()[0]) <= 25


def test_stages_with_nulls_repeats_clashing_columns_and_no_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(3)
    odd = docs.withColumns({"text": F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit("")), "source": F.lit(None).cast("string")})
    odd = odd.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")))  # 3 ids twice, 3 rows without
    odd = odd.withColumns({c: F.lit(i) for i, c in enumerate(("score", "hits", "blob", "id", "size", "component_id"))})
    for name, rows in (("odd", odd), ("none", odd.limit(0))):
        rows.write.parquet(str(tmp_path / name))
        now, sizes = spark.read.parquet(str(tmp_path / name)), []
        for stage, step in cp.STAGES:
            step(spark, now, DATA).write.parquet(str(tmp_path / f"{name}-{stage}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
            assert stage == "mixing" or out.columns == now.columns
            now = out
            sizes.append(out.count())
        assert sizes == ([9, 6, 6, 6, 6] if name == "odd" else [0] * 5)


def test_no_stage_broadcasts_what_spark_sizes_too_low(spark, tmp_path):
    """Postings (32 for each text) and rows of documents have small files, but are no small tables: joins don't broadcast them."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(f"{words[(i + k) % 10]}{(i // 2) * 37 + k}" for k in range(30 + i % 2)), "en", "web") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).write.parquet(str(tmp_path / "documents.parquet"))
    docs, store = spark.read.parquet(str(tmp_path / "documents.parquet")), spark._jsparkSession.sharedState().statusStore()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")  # as 10 MB are to a quarter of a million texts
    try:
        for name, most in (("near_duplicates", 2000), ("secrets", 0), ("mixing", 256)):  # texts, none, and buckets of a source
            before = store.executionsCount()
            dict(cp.STAGES)[name](spark, docs, DATA).write.parquet(str(tmp_path / name))
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            sent = []
            for i in range(before, store.executionsCount()):
                run = store.executionsList().apply(i).executionId()
                nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
                for node in map(nodes.apply, range(nodes.size())):
                    if node.name() == "BroadcastExchange":
                        metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                        sent += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
            assert max(sent, default=0) <= most, (name, sent)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
