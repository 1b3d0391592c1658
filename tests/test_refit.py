"""Refits in the stream: versions, replays, and rows scored by the version that was noted."""

from pyspark.sql import functions as F

from riskloom.functions import catalog as K
from riskloom.operators import model as M
from riskloom.session import scratch_path
from riskloom.streaming import pipelines as P
from riskloom.streaming import refit as R

FIT = {**K.GBT_PARAMS, "maxIter": 2, "maxDepth": 2}
CODE = ["import os\nos.system(a)", "def add(a, b):\n    return a + b", "eval(x)", "print('hello')"]


def examples(spark, lo, hi):
    return spark.createDataFrame([(f"h{k}", k, f"{CODE[k % 4]}\nv{k % 5} = {k}", [0.9, 0.0, 0.95, 0.1][k % 4]) for k in range(lo, hi)],
                                 "hash string, ord long, code string, risk_score double")


def test_versions_and_replays(spark):
    src, store_path, out = (scratch_path(spark, f"t-refit-{n}") for n in ("src", "store", "out"))
    commits = scratch_path(spark, "t-refit-commits")
    models = R.ModelStore(spark, scratch_path(spark, "t-refit-models"))
    c = examples(spark, 0, 8).select(F.col("ord").alias("commit_id"), F.col("code").alias("code_content"))

    def learn(lo, hi):
        examples(spark, lo, hi).coalesce(1).write.mode("append").parquet(src)
        return R.stream_refit(P.read_stream(spark, src, examples(spark, 0, 0).schema), store_path, models, step=20, params=FIT, buckets=4)

    def score():
        c.coalesce(1).write.mode("append").parquet(commits)
        R.stream_score(P.read_stream(spark, commits, c.schema), out, models)
        return sorted({(r.b, r.model_version) for r in spark.read.parquet(out).collect()}, key=lambda r: r[0])

    assert learn(0, 15) == [] and models.versions() == []
    assert score() == [(0, None)]  # nothing is fitted: the score that stands in
    assert learn(15, 25) == [25] and models.versions() == [25]
    assert score() == [(0, None), (1, 25)]
    assert learn(20, 30) == [] and models.versions() == [25]  # 30 examples: no multiple of 20 crossed
    assert learn(30, 45) == [45] and models.versions() == [25, 45]
    # a half-written version does not count
    M.save_model(models.load(45), f"{models.root}/v=99")
    fs = spark._jvm.org.apache.hadoop.fs.Path(models.root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{models.root}/v=99/meta/_SUCCESS"), False)
    assert models.versions() == [25, 45]
    # a batch that noted its version before a failure keeps to it in the replay
    spark.createDataFrame([(25,)], "version long").coalesce(1).write.parquet(f"{out}.versions/batch=2")
    assert score() == [(0, None), (1, 25), (2, 25)] and score()[-1] == (3, 45)
    want = {r.commit_id: r.model_score for r in M.model_score(models.load(45), c).collect()}
    got = {r.commit_id: r.model_score for r in spark.read.parquet(out).where("b = 3").collect()}
    assert got == want
