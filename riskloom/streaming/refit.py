"""A model that is fitted again as examples arrive, and rows scored by the newest.

* ``ModelStore``: fitted models side by side, a version each.  A version is the
  number of examples it was fitted on, so a fit that is repeated after a failure
  writes the same version again; a version counts when all of it is written.
* ``stream_refit``: ``stream_learn`` with a fit into the store.
* ``stream_score``: every micro-batch takes the newest version there is, notes it
  before it scores, and keeps to it if the batch is replayed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import RETRAIN_STEP
from ..functions.features import heuristic_score, with_features
from ..operators import model as M
from ..session import path_exists
from . import pipelines as P


class ModelStore:
    """Models under ``root/v=<version>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        """Versions that are written whole (their description comes last)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v=*/meta/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getParent().getName()[2:]) for f in found or [])

    def publish(self, model: M.RiskModel, version: int) -> None:
        M.save_model(model, f"{self.root}/v={version}")

    def load(self, version: int) -> M.RiskModel:
        return M.load_model(self.spark, f"{self.root}/v={version}")


def stream_refit(verdicts: DataFrame, store_path: str, models: ModelStore, step: int = RETRAIN_STEP, params: dict | None = None,
                 checkpoint: str | None = None, buckets: int | None = None) -> list[int]:
    """Append labelled examples (hash, ord, code, risk_score) and fit again whenever
    their number crosses a multiple of ``step`` and suffices for a fit; the
    sizes at which it did."""
    fitted: list[int] = []

    def retrain(examples: DataFrame) -> None:
        version = examples.count()
        model, _ = M.train_model(examples, params=params)
        if model is not None:
            models.publish(model, version)
            fitted.append(version)

    P.stream_learn(verdicts, store_path, retrain, step, checkpoint, buckets)
    return fitted


def stream_score(stream: DataFrame, out_path: str, models: ModelStore, id_col: str = "commit_id", code_col: str = "code_content",
                 checkpoint: str | None = None) -> None:
    """(id, model_version, model_score) of every row.  Before there is a model the
    version is null and the score is the one that stands in for it."""
    spark = stream.sparkSession
    noted = T.StructType([T.StructField("version", T.LongType())])

    def score(batch: DataFrame, batch_id: int) -> None:
        note = f"{out_path.rstrip('/')}.versions/batch={batch_id}"
        if not path_exists(spark, os.path.join(note, "_SUCCESS")):
            newest = max(models.versions(), default=None)
            spark.createDataFrame([(newest,)], noted).coalesce(1).write.mode("overwrite").parquet(note)
        version = spark.read.schema(noted).parquet(note).first().version
        if version is None:
            scored = with_features(batch.select(id_col, code_col), code_col) \
                .select(id_col, heuristic_score(F.col("f_max_severity"), F.col("f_hits")).alias("model_score"))
        else:
            scored = M.model_score(models.load(version), batch, code_col, id_col).select(id_col, "model_score")
        rows = scored.select(id_col, F.lit(version).cast("long").alias("model_version"), "model_score")
        P.append_batch(spark, rows, out_path, batch_id)

    P.run_available(stream.writeStream.foreachBatch(score), out_path, checkpoint)
