"""Risk model: relational TF-IDF + scaled numeric features -> boosted trees.

Training fits the trees of Spark ML's ``GBTRegressor`` to a sparse matrix of all
labelled examples (:mod:`riskloom.operators.boosting`).  Scoring the
corpus does not go through Python: the fitted trees are compiled into one
native column expression over the per-document sparse tf-idf map and the
scaled features, so it stays inside Spark's generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import GBT_PARAMS, MIN_TRAIN_SAMPLES, MODEL_VERSION, VOCAB_SIZE
from ..functions.features import FEATURE_NAMES, code_tokens, with_features
from ..session import checkpoint_root, materialize, path_exists, scratch_path
from . import boosting
from . import text_model as tm
from .training import kfold_assign

ID = "hash"
#: Rows for a task of a fit: at most, where there are cores for more tasks, and at least.
FIT_PARTITION_ROWS = 20_000
FIT_TASK_ROWS = 4_000


# -- numeric features -------------------------------------------------------

def feature_ranges(feats: DataFrame) -> DataFrame:
    """min/max of every numeric feature over a training set (one row)."""
    return feats.agg(*[a for c in FEATURE_NAMES for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])


def scale_with(ranges: dict[str, tuple[float, float]]) -> list[Column]:
    """Min-max scaling with fitted bounds; a constant training column maps
    to x - min (0 on the training set), values may leave [0, 1]."""
    out = []
    for c in FEATURE_NAMES:
        lo, hi = ranges[c]
        rng = (hi - lo) if hi != lo else 1.0
        out.append(((F.col(c) - F.lit(lo)) / F.lit(rng)).alias(f"s_{c}"))
    return out


def scaled_features(feats: DataFrame) -> DataFrame:
    """Scaling fitted on ``feats`` itself (the bounds stay inside Spark as
    one scalar subquery)."""
    r = feature_ranges(feats)
    rs = F.struct(*[F.col(x) for x in r.columns])
    d = feats.withColumn("_r", r.select(rs.alias("r")).scalar())
    cols = []
    for c in FEATURE_NAMES:
        lo, hi = F.col(f"_r.min_{c}"), F.col(f"_r.max_{c}")
        rng = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
        cols.append(((F.col(c) - lo) / rng).alias(f"s_{c}"))
    return d.select(*[c for c in feats.columns], *cols)


# -- texts --------------------------------------------------------------------

def text_table(docs: DataFrame, code_col: str = "code", id_col: str = ID, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``, features, tokens) of every row, dealt out by id and stored: the
    vocabulary, the ranges, the matrix and any number of scorings of the same texts
    read it, and no regex runs twice over a text."""
    rows = tm.spread(docs.select(id_col, code_col, *keep), id_col)
    feats = with_features(rows, code_col).withColumn(tm.TOKENS, code_tokens(F.col(code_col)))
    return materialize(feats.select(id_col, *keep, *FEATURE_NAMES, tm.TOKENS), "texts")


def _features(docs: DataFrame, code_col: str, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The features of a table of texts, or made from the code."""
    if tm.TOKENS in docs.columns:
        return docs.select(id_col, *keep, *FEATURE_NAMES)
    return with_features(tm.spread(docs.select(id_col, code_col, *keep), id_col), code_col)


# -- fitted model -------------------------------------------------------------

@dataclass
class Prepared:
    """What a fit starts from: vocabulary, ranges and the stored matrix."""

    vocab: DataFrame                      # term, idx, idf (<= VOCAB_SIZE rows), stored
    n_terms: int
    ranges: dict[str, tuple[float, float]]
    matrix: DataFrame                     # id, label, features, stored
    sample_count: int


@dataclass
class RiskModel:
    vocab: DataFrame
    n_terms: int
    ranges: dict[str, tuple[float, float]]
    gbt: object                           # pyspark.ml GBTRegressionModel
    stats: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return self.n_terms + len(FEATURE_NAMES)


def design_matrix(examples: DataFrame, vocab: DataFrame, n_terms: int, ranges, code_col: str = "code",
                  id_col: str = ID, label_col: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(id, label?, features VECTOR): tf-idf entries then scaled numerics, of codes or of
    a :func:`text_table`.
    The vector is put together as the struct that a vector is stored as,
    written once, and read back as a vector; no Python touches the rows."""
    from pyspark.ml.linalg import VectorUDT

    sparse = tm.tfidf_sparse(tm.vocab_counts(examples, vocab, id_col, code_col) if counts is None else counts, vocab, id_col)
    label = [] if label_col is None else [F.col(label_col).cast("double").alias("label")]
    feats = _features(examples, code_col, id_col, () if label_col is None else (label_col,)) \
        .select(id_col, *label, *scale_with(ranges))
    ent = F.coalesce(F.col("entries"), F.array().cast("array<struct<idx:int,weight:double>>"))
    idx = F.concat(F.transform(ent, lambda e: e["idx"]), F.array(*[F.lit(n_terms + i) for i in range(len(FEATURE_NAMES))]))
    vals = F.concat(F.transform(ent, lambda e: e["weight"]), F.array(*[F.col(f"s_{c}") for c in FEATURE_NAMES]))
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(n_terms + len(FEATURE_NAMES)).alias("size"),
                      idx.alias("indices"), vals.alias("values"))
    names = [id_col, *(["label"] if label else [])]
    rows = feats.join(sparse, id_col, "left").select(*names, vector.alias("features"))
    schema = T.StructType([*[rows.schema[n] for n in names], T.StructField("features", VectorUDT())])
    path = scratch_path(examples.sparkSession, "matrix")
    rows.write.parquet(path)
    return examples.sparkSession.read.schema(schema).parquet(path)


def bounded_examples(examples: DataFrame, most: int, id_col: str = ID) -> DataFrame:
    """At most ``most`` examples, those with the smallest hashes; no fit is bounded by it."""
    return examples.orderBy(id_col).limit(most) if examples.count() > most else examples


def prepare(examples: DataFrame, code_col: str = "code", label_col: str = "risk_score", id_col: str = ID) -> Prepared:
    """Tokenise once, choose the vocabulary, find the ranges, store the matrix of all examples."""
    checkpoint_root(examples.sparkSession)  # boosting cuts its lineage there
    examples = text_table(examples, code_col, id_col, (label_col,))
    n, ids = examples.agg(F.count("*"), F.count_distinct(id_col)).first()
    vocab, counts = tm.vocabulary(examples, n, id_col, code_col, VOCAB_SIZE, unique=ids == n)
    n_terms = vocab.count()
    fr = feature_ranges(examples).first()
    ranges = {c: (float(fr[f"min_{c}"]), float(fr[f"max_{c}"])) for c in FEATURE_NAMES} if n else {}
    matrix = design_matrix(examples, vocab, n_terms, ranges, code_col, id_col, label_col, counts) if n else examples
    return Prepared(vocab, n_terms, ranges, matrix, n)


def fit_partitions(spark, rows: int, together: int = 1) -> int:
    """A partition per core (of those that each of ``together`` concurrent fits
    gets), but of no fewer than FIT_TASK_ROWS and no more than FIT_PARTITION_ROWS rows."""
    cores = max(1, spark.sparkContext.defaultParallelism // together)
    return max(1, rows // FIT_PARTITION_ROWS, min(cores, rows // FIT_TASK_ROWS))


def _estimator(params: dict | None):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol="label", **(params or GBT_PARAMS))


def fit(prepared: Prepared, params: dict | None = None):
    """One boosted fit on all rows of the matrix, its columns dealt to as many tasks as the rows are worth."""
    tasks = fit_partitions(prepared.matrix.sparkSession, prepared.sample_count)
    return boosting.fit(prepared.matrix, prepared.n_terms + len(FEATURE_NAMES), tasks, _estimator(params))


def train_model(examples: DataFrame, force: bool = False, params: dict | None = None, code_col: str = "code",
                label_col: str = "risk_score", id_col: str = ID, order_col: str | None = None):
    """Fit on all examples; fewer than
    MIN_TRAIN_SAMPLES without ``force`` returns (None, skipped-status).  With an
    ``order_col`` the statistics hold the cross-validated ``mae`` of contiguous
    folds in that order, which takes a further fit per fold."""
    n = examples.count()
    if n < MIN_TRAIN_SAMPLES and not force:
        return None, {"status": "skipped", "reason": f"Only {n} samples — need at least {MIN_TRAIN_SAMPLES}",
                      "sample_count": n}
    p = prepare(examples, code_col, label_col, id_col)
    stats = {"sample_count": p.sample_count, "version": MODEL_VERSION, "trained_at": datetime.now(timezone.utc).replace(tzinfo=None).isoformat()}
    if order_col is not None:
        folds = kfold_assign(examples.join(p.matrix.select(id_col), id_col, "left_semi"), p.sample_count, order_col)
        stats["mae"] = round(cv_mae(p, folds, params, id_col)[1], 4)
    model = RiskModel(p.vocab, p.n_terms, p.ranges, fit(p, params), stats)
    return model, {"status": "trained", **model.stats}


# -- native scoring -----------------------------------------------------------

def _trees(model: RiskModel) -> list:
    """The trees as (feature, threshold, left, right), or a number for a leaf, read from
    the library's own description of them: one call, where a walk over the nodes takes many."""
    lines = iter([x.strip() for x in model.gbt.toDebugString.splitlines()[1:] if x.strip()])

    def node():
        kind, _, rest = next(lines).partition(" ")
        if kind == "Predict:":
            return float(rest)
        feature, _, threshold = rest.removeprefix("(feature ").removesuffix(")").partition(" <= ")
        left = node()
        next(lines)  # Else
        return int(feature), float(threshold), left, node()

    return [node() for _ in lines]  # each begins with a line of its own


def _node_expr(node, value) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    j, threshold, left, right = node
    return F.when(value(j) <= F.lit(threshold), _node_expr(left, value)).otherwise(_node_expr(right, value))


def _node_sql(node, name) -> str:
    """``_node_expr`` as text, which Spark takes whole instead of node by node."""
    if isinstance(node, float):
        return f"{node!r}D"
    j, threshold, left, right = node
    return f"CASE WHEN {name(j)} <= {threshold!r}D THEN {_node_sql(left, name)} ELSE {_node_sql(right, name)} END"


def _split_features(node, out: set) -> set:
    if not isinstance(node, float):
        out.add(node[0])
        _split_features(node[2], out)
        _split_features(node[3], out)
    return out


def used_features(model: RiskModel) -> list[int]:
    """Feature indices that some split reads (usually a few hundred)."""
    out: set = set()
    for t in _trees(model):
        _split_features(t, out)
    return sorted(out)


def _x(j: int) -> str:
    return f"_x{j}"


def feature_columns(model: RiskModel, tfidf_map: Column) -> list[Column]:
    """One column per used term weight (looked up once per row, not once
    per tree node)."""
    return [F.coalesce(F.element_at(tfidf_map, F.lit(j)), F.lit(0.0)).alias(_x(j))
            for j in used_features(model) if j < model.n_terms]


def model_expression(model: RiskModel, tfidf_map: Column | None = None, chunk: int = 0) -> list[Column]:
    """Weighted tree sums as native expressions over the columns of
    :func:`feature_columns` (or the map itself when ``tfidf_map`` is given);
    ``chunk`` > 0 splits the forest into partial sums of that many trees so
    each stays small enough for generated code."""
    n = model.n_terms

    def name(j: int) -> str:
        return _x(j) if j < n else f"s_{FEATURE_NAMES[j - n]}"

    def value(j: int) -> Column:
        return F.coalesce(F.element_at(tfidf_map, F.lit(j)), F.lit(0.0)) if j < n else F.col(name(j))

    weighted = list(zip(model.gbt.treeWeights, _trees(model), strict=True))
    size = chunk if chunk > 0 else len(weighted)
    chunks = [weighted[i:i + size] for i in range(0, len(weighted), size)]
    if tfidf_map is None:
        return [F.expr(" + ".join(f"{float(w)!r}D * {_node_sql(t, name)}" for w, t in c)) for c in chunks]
    return [reduce(lambda a, b: a + b, [F.lit(w) * _node_expr(t, value) for w, t in c]) for c in chunks]


def model_score(model: RiskModel, docs: DataFrame, code_col: str = "code_content", id_col: str = "commit_id",
                chunk: int = 10, counts: DataFrame | None = None):
    """max(regressor, catalog-B floor), clamped to [0, 1], 4 places; ``docs`` holds codes or is
    a :func:`text_table`.  ``counts``: their ``vocab_counts``, if they are there already."""
    used = [j for j in used_features(model) if j < model.n_terms]
    counts = tm.vocab_counts(docs, model.vocab, id_col, code_col) if counts is None else counts
    # the norm is over the whole vocabulary; of the weights only those that some split reads are kept
    sparse = tm.tfidf_sparse(counts, model.vocab, id_col) \
        .select(id_col, F.map_from_entries(F.filter("entries", lambda e: e["idx"].isin(used))).alias("_m"))
    feats = _features(docs, code_col, id_col)
    base = feats.select(id_col, "f_max_severity", *scale_with(model.ranges)).join(sparse, id_col, "left") \
        .withColumn("_m", F.coalesce(F.col("_m"), F.create_map().cast(T.MapType(T.IntegerType(), T.DoubleType()))))
    x = base.select(id_col, "f_max_severity", *[f"s_{c}" for c in FEATURE_NAMES],
                    *feature_columns(model, F.col("_m")))
    sums = model_expression(model, chunk=chunk)
    p = x.select(id_col, "f_max_severity", *[c.alias(f"_p{i}") for i, c in enumerate(sums)])
    raw = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(sums))])
    s = F.greatest(raw, F.col("f_max_severity"))
    return p.select(id_col, raw.alias("raw_score"),
                    F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 4).alias("model_score"))


# -- evaluation -------------------------------------------------------------

def cv_mae(prepared: Prepared, folds: DataFrame, params: dict | None = None, id_col: str = ID) -> tuple[int, float]:
    """(k, mean over folds of the held-out MAE): exactly k fits, each of the
    regressor alone on the matrix built from all rows (the source protocol).
    They are made side by side, from columns that are dealt out once."""
    x = prepared.matrix.join(folds.select(id_col, "fold"), id_col)
    k = folds.agg(F.max("fold")).first()[0] + 1
    tasks = fit_partitions(x.sparkSession, prepared.sample_count)
    maes = boosting.fold_errors(x, prepared.n_terms + len(FEATURE_NAMES), tasks, k, _estimator(params))
    return k, float(sum(maes) / len(maes))


def mean_mae(prepared: Prepared, folds: DataFrame, id_col: str = ID) -> float:
    """The MAE over the same folds of a predictor that knows the mean label of the
    other folds alone: what a fit has to beat."""
    x = prepared.matrix.select(id_col, "label").join(folds.select(id_col, "fold"), id_col)
    per = x.groupBy("fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))  # one row per fold
    total = per.agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rest = per.crossJoin(total.toDF("all_s", "all_n")).select("fold", ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("mean"))
    errors = x.join(F.broadcast(rest), "fold").groupBy("fold").agg(F.avg(F.abs(F.col("label") - F.col("mean"))).alias("mae"))
    return float(errors.agg(F.avg("mae")).first()[0])


def save_model(model: RiskModel, path: str) -> None:
    import json
    import os

    model.gbt.write().overwrite().save(os.path.join(path, "gbt"))
    model.vocab.write.mode("overwrite").parquet(os.path.join(path, "vocab"))
    spark = model.vocab.sparkSession
    meta = {"n_terms": model.n_terms, "ranges": model.ranges, "stats": model.stats}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(os.path.join(path, "meta"))


def load_model(spark, path: str) -> RiskModel | None:
    """The saved model, or None when nothing is saved (untrained)."""
    import json
    import os

    from pyspark.ml.regression import GBTRegressionModel

    if not path_exists(spark, os.path.join(path, "meta")):
        return None
    meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
    gbt = GBTRegressionModel.load(os.path.join(path, "gbt"))
    vocab = spark.read.parquet(os.path.join(path, "vocab"))
    ranges = {k: tuple(v) for k, v in meta["ranges"].items()}
    return RiskModel(vocab, int(meta["n_terms"]), ranges, gbt, meta["stats"])
