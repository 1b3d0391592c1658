"""Registered queries: training store, n-gram TF-IDF, feature scaling,
the boosted-tree model, the SQL function and the table views.

The training corpus is the teacher-labelled store: ``training_raw`` kept
first per hash (the store refuses repeated hashes).  The model queries
return sizes and row properties, for which an exact oracle exists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as K
from ..functions.features import FEATURE_NAMES, with_features
from ..operators import model as M
from ..operators import routing, scan, training
from ..operators import text_model as tm
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources import sinks
from . import oracle as O
from .registry import register

# --------------------------------------------------------------- shared SQL

_TIERS_SQL = ("SELECT tier, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM (VALUES "
              + ", ".join(f"({O.q(t)}, {lo!r}, {hi!r})" for t, lo, hi in K.TIER_RANGES) + ") AS t(tier, lo, hi)")

_TOKEN_RE2 = r"[\p{L}\p{N}_]{2,}"

TEXT_CTES = {
    "_ex": ("SELECT hash, code, risk_score, source, ord FROM (SELECT *, row_number() OVER "
            "(PARTITION BY hash ORDER BY ord) AS rn FROM training_raw) WHERE rn = 1"),
    "_tok": f"SELECT hash, regexp_extract_all(lower({O.normalize_sql('code')}), {O.q(_TOKEN_RE2)}) AS tk FROM _ex",
    "_grams": ("SELECT hash, unnest(tk) AS term FROM _tok\nUNION ALL\n"
               "SELECT hash, unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) FROM _tok\n"
               "UNION ALL\nSELECT hash, unnest(list_transform(range(1, len(tk) - 1), "
               "lambda i: tk[i] || ' ' || tk[i + 1] || ' ' || tk[i + 2])) FROM _tok"),
    "_counts": "SELECT hash, term, count(*) AS tf FROM _grams GROUP BY hash, term",
    "_stats": "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM _counts GROUP BY term",
    "_top": f"SELECT term, tf, df FROM _stats ORDER BY tf DESC, term LIMIT {K.VOCAB_SIZE}",
    "_vocab": ("SELECT term, tf, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, "
               "ln((1 + (SELECT count(*) FROM _ex)) / (1 + df)) + 1 AS idf FROM _top"),
    "_w": ("SELECT c.hash, c.term, c.tf, v.idx, v.idf, (1 + ln(c.tf)) * v.idf AS w "
           "FROM _counts c JOIN _vocab v ON c.term = v.term"),
}


def text_sql(body: str, *views: str) -> str:
    return O.with_views(body, "training_raw", *views, extra=TEXT_CTES)


_RAW = O.features_sql("code")
_FC = O.feature_cols_sql()
FEAT_CTES = {
    **{k: TEXT_CTES[k] for k in ["_ex"]},
    "_f": ("SELECT hash, " + ", ".join(f"{v} AS {k}" for k, v in _FC.items())
           + " FROM (SELECT hash, " + ", ".join(f"{v} AS {k}" for k, v in _RAW.items()) + " FROM _ex)"),
    "_r": "SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURE_NAMES) + " FROM _f",
}


def feat_sql(body: str) -> str:
    return O.with_views(body, "training_raw", extra=FEAT_CTES)


def examples(spark, sf):
    """The training store: labelled examples, first per hash."""
    return training.keep_first_example(fx.training_raw(spark, sf))


# ----------------------------------------------------------- table views


@register("users", O.with_views("SELECT user_id, username, email FROM users", "users"))
def q_users(spark, sf):
    return fx.users(spark, sf).select("user_id", "username", "email")


@register("commits", O.with_views(
    "SELECT commit_id, user_id, code_content, created_at FROM commits", "commits"))
def q_commits(spark, sf):
    return fx.commits(spark, sf).select("commit_id", "user_id", "code_content", "created_at")


# ------------------------------------------------------------ evidence


def _evidence_top3_sql() -> str:
    parts = []
    for ci, cat, _ in K.categories_a():
        m = O.cat_matches_sql("code_content", ci)
        parts.append(f"SELECT commit_id, {O.q(cat)} AS category, m[1] AS e1, m[2] AS e2, m[3] AS e3 "
                     f"FROM (SELECT commit_id, {m} AS m FROM commits) WHERE len(m) > 0")
    return O.with_views("\nUNION ALL\n".join(parts), "commits")


@register("evidence_top3", _evidence_top3_sql())
def q_evidence_top3(spark, sf):
    # explode_outer + null filter: a plain explode gets an inferred
    # size(evidence) > 0 filter that re-runs the rule scan below it
    f = scan.with_findings(fx.commits(spark, sf)).select("commit_id", F.explode_outer("evidence").alias("e")) \
        .where(F.col("e").isNotNull())
    return f.select("commit_id", F.col("e.category").alias("category"),
                    *[F.get(F.col("e.matches"), i).alias(f"e{i + 1}") for i in range(3)])


# ------------------------------------------------------ training store


@register("score_to_tier", O.with_views(
    "SELECT t.ord, t.risk_score, r.tier FROM training_raw t LEFT JOIN _tiers r "
    "ON t.risk_score >= r.lo AND t.risk_score <= r.hi", "training_raw", extra={"_tiers": _TIERS_SQL}))
def q_score_to_tier(spark, sf):
    j = training.score_to_tier(fx.training_raw(spark, sf), training.tiers(spark))
    return j.select("ord", "risk_score", "tier")


@register("training_stats", O.with_views(
    f"SELECT count(*) AS sample_count, count(DISTINCT hash) AS distinct_hashes, "
    f"count(*) >= {K.MIN_TRAIN_SAMPLES} AS trainable, "
    "(SELECT string_agg(concat(source, '=', n), ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM training_raw GROUP BY source)) "
    "AS source_mix FROM training_raw", "training_raw"))
def q_training_stats(spark, sf):
    return training.training_stats(fx.training_raw(spark, sf))


_TEACH_NUM = f"regexp_extract({O.strip_sql("coalesce(r.content, '')")}, '([0-9]\\.[0-9]+|[01])', 1)"
_TEACH = (f"CASE WHEN {_TEACH_NUM} = '' THEN NULL ELSE round(least(greatest(CAST({_TEACH_NUM} AS DOUBLE), "
          f"{O.dbl(0.0)}), {O.dbl(1.0)}), 4) END")


@register("seed_outcome", O.with_views(
    "SELECT count_if(ok AND NOT stored AND first) AS seeded, count_if(NOT ok) AS failed, "
    "count_if(ok AND NOT (NOT stored AND first)) AS duplicate FROM (\n"
    "  SELECT *, row_number() OVER (PARTITION BY hash, ok ORDER BY ord) = 1 AS first FROM (\n"
    "    SELECT l.*, (code IS NOT NULL AND risk_score IS NOT NULL) AS ok,\n"
    "           hash IN (SELECT hash FROM training_raw WHERE source = 'openrouter_seed') AS stored\n"
    f"    FROM (SELECT t.hash, t.code, t.ord, {_TEACH} AS risk_score FROM training_raw t\n"
    "          LEFT JOIN llm_responses r ON r.commit_id = t.ord WHERE t.source = 'live_commit') l))",
    "training_raw", "llm_responses"))
def q_seed_outcome(spark, sf):
    from ..operators.verdicts import teacher_score
    t = fx.training_raw(spark, sf)
    r = fx.llm_responses(spark, sf)
    lab = t.where("source = 'live_commit'").join(r, r["commit_id"] == t["ord"], "left") \
        .select("hash", "code", "ord", teacher_score(F.col("content")).alias("risk_score"))
    return training.seed_outcome(lab, t.where("source = 'openrouter_seed'"))


@register("kfold_assign", text_sql(
    "SELECT hash, ord, CAST(CASE WHEN r < (n % k) * (n // k + 1) THEN r // (n // k + 1) "
    "ELSE (n % k) + (r - (n % k) * (n // k + 1)) // greatest(n // k, 1) END AS BIGINT) AS fold FROM ("
    "SELECT *, least(5, greatest(2, n // 4)) AS k FROM ("
    "SELECT hash, ord, row_number() OVER (ORDER BY ord) - 1 AS r, count(*) OVER () AS n FROM _ex))"))
def q_kfold_assign(spark, sf):
    return training.kfold_assign(examples(spark, sf)).select("hash", "ord", "fold")


@register("read_training", O.with_views(
    "SELECT hash, code, round(risk_score, 4) AS risk_score, source FROM training_raw", "training_raw"))
def q_read_training(spark, sf):
    """Examples written as JSON lines into a folder that also holds
    non-JSON text lines (the reviewer replies); the tolerant read keeps
    exactly the examples."""
    path = scratch_path(spark, "training-jsonl")
    sinks.append_training(fx.training_raw(spark, sf), path)
    fx.llm_responses(spark, sf).select("content").write.mode("append").text(path)
    return sinks.read_training(spark, path)


@register("append_training", O.with_views(
    "SELECT hash, code, round(risk_score, 4) AS risk_score, source FROM training_raw "
    "WHERE source = 'openrouter_seed'\nUNION ALL\n"
    "SELECT hash, code, round(risk_score, 4) AS risk_score, source FROM (SELECT *, row_number() OVER "
    "(PARTITION BY hash ORDER BY ord) AS rn FROM training_raw WHERE source = 'live_commit') t WHERE rn = 1 AND "
    "hash NOT IN (SELECT hash FROM training_raw WHERE source = 'openrouter_seed')", "training_raw"))
def q_append_training(spark, sf):
    """Seed examples stored first; the live batch appends only hashes the
    store does not hold yet; the store is read back whole."""
    t = fx.training_raw(spark, sf)
    path = scratch_path(spark, "training-store")
    seed = t.where("source = 'openrouter_seed'")
    sinks.append_training(seed, path)
    stored = sinks.read_training(spark, path)
    new = training.new_training_examples(stored, t.where("source = 'live_commit'"))
    sinks.append_training(new, path)
    return sinks.read_training(spark, path)


# --------------------------------------------------------- n-gram tf-idf


def _counts(spark, sf):
    return tm.ngram_counts(examples(spark, sf), "hash", "code", unique=True)  # first per hash


def _tfidf_parts(spark, sf):
    """(counts, vocab): the vocabulary by a sketch and an exact count of its
    candidates, so a table of all n-grams, larger than the text, neither moves nor is stored."""
    ex = materialize(examples(spark, sf).select("hash", "code"), "examples")  # read in each of the passes
    vocab, counts = tm.vocabulary(ex, ex.count(), "hash", unique=True)
    return counts, vocab


def _vocab(spark, sf):
    return _tfidf_parts(spark, sf)[1]


@register("ngram_counts", text_sql("SELECT hash, term, tf FROM _counts"))
def q_ngram_counts(spark, sf):
    return _counts(spark, sf)


@register("term_stats", text_sql("SELECT term, tf, df FROM _stats"))
def q_term_stats(spark, sf):
    return tm.term_stats(_counts(spark, sf), "hash")


@register("vocab_topk", text_sql("SELECT term, tf, df, idx, round(idf, 6) AS idf FROM _vocab"))
def q_vocab_topk(spark, sf):
    return _vocab(spark, sf).select("term", "tf", "df", "idx", F.round("idf", 6).alias("idf"))


@register("tfidf_weight", text_sql(
    "SELECT hash, term, tf, idx, round(idf, 6) AS idf, round(w, 6) AS weight FROM _w"))
def q_tfidf_weight(spark, sf):
    counts, _ = _tfidf_parts(spark, sf)
    w = (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf")
    return counts.select("hash", "term", "tf", "idx", F.round("idf", 6).alias("idf"), F.round(w, 6).alias("weight"))


@register("tfidf_vectors", text_sql(
    "SELECT hash, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY hash)), 6) AS weight FROM _w"))
def q_tfidf_vectors(spark, sf):
    counts, vocab = _tfidf_parts(spark, sf)
    t = tm.tfidf_long(counts, vocab, "hash")
    return t.select("hash", "idx", F.round("weight", 6).alias("weight"))


# ------------------------------------------------------ feature scaling


@register("feature_ranges", feat_sql(
    "SELECT " + ", ".join(f"round(lo_{c}, 6) AS min_{c}, round(hi_{c}, 6) AS max_{c}" for c in FEATURE_NAMES)
    + " FROM _r"))
def q_feature_ranges(spark, sf):
    r = M.feature_ranges(with_features(examples(spark, sf), "code"))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register("scaled_features", feat_sql(
    "SELECT hash, " + ", ".join(
        f"round((f.{c} - lo_{c}) / CASE WHEN hi_{c} = lo_{c} THEN 1.0 ELSE hi_{c} - lo_{c} END, 6) AS s_{c}"
        for c in FEATURE_NAMES) + " FROM _f f, _r"))
def q_scaled_features(spark, sf):
    # stored, as the bounds and the scaling both read them: no second pass over the texts
    f = with_features(examples(spark, sf), "code").select("hash", *FEATURE_NAMES)
    s = M.scaled_features(materialize(f, "features"))
    return s.select("hash", *[F.round(f"s_{c}", 6).alias(f"s_{c}") for c in FEATURE_NAMES])


# ----------------------------------------------------------- SQL surface


@register("sql_risk_score", O.with_views(
    f"SELECT commit_id, round({O.floor_sql('code_content')}, 4) AS risk_score FROM commits", "commits"))
def q_sql_risk_score(spark, sf):
    from ..functions.sql_functions import register_sql_functions
    register_sql_functions(spark)
    return spark.sql("SELECT commit_id, predict_risk_score(code_content) AS risk_score FROM {c}",
                     c=fx.commits(spark, sf).select("commit_id", "code_content"))


# --------------------------------------------------------------- model
# A fit is iterative, so the queries return what has an exact oracle: sizes,
# status, and properties that every row must have.

_MODELS: dict = {}


def trained_model(spark, sf):
    """One fit per application and table folder, shared by the model queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = M.train_model(examples(spark, sf))
    return _MODELS[key]


@register("train_model", text_sql(
    f"SELECT 'trained' AS status, (SELECT count(*) FROM _ex) AS sample_count, (SELECT count(*) FROM _top) AS n_terms, "
    f"CAST({K.GBT_PARAMS['maxIter']} AS BIGINT) AS n_trees, {O.q(K.MODEL_VERSION)} AS version"))
def q_train_model(spark, sf):
    model, status = trained_model(spark, sf)
    n_trees = len(model.gbt.trees) if model is not None else 0
    n_terms = model.n_terms if model is not None else 0
    return spark.createDataFrame(
        [(status["status"], int(status["sample_count"]), int(n_terms), int(n_trees), K.MODEL_VERSION)],
        "status string, sample_count long, n_terms long, n_trees long, version string")


@register("model_score", O.with_views("SELECT commit_id, true AS in_range, true AS at_least_floor, true AS same_as_trees FROM commits", "commits"))
def q_model_score(spark, sf):
    """Every commit's score lies in [0, 1], is not below the catalog-B floor, and comes
    out of the same trees when the library that fitted them is asked."""
    model, _ = trained_model(spark, sf)
    c = M.text_table(fx.commits(spark, sf), "code_content", "commit_id")
    counts = materialize(tm.vocab_counts(c, model.vocab, "commit_id"), "counts")
    matrix = M.design_matrix(c, model.vocab, model.n_terms, model.ranges, "code_content", "commit_id", counts=counts)
    asked = model.gbt.transform(matrix).select("commit_id", "prediction")
    s = M.model_score(model, c, counts=counts).join(c.select("commit_id", "f_max_severity"), "commit_id").join(asked, "commit_id")
    return s.select("commit_id", F.col("model_score").between(0.0, 1.0).alias("in_range"),
                    (F.col("model_score") >= F.round(F.least("f_max_severity", F.lit(1.0)), 4)).alias("at_least_floor"),
                    (F.abs(F.col("raw_score") - F.col("prediction")) < 1e-9).alias("same_as_trees"))


@register("cv_mae", text_sql(
    "SELECT CAST(least(5, greatest(2, (SELECT count(*) FROM _ex) // 4)) AS BIGINT) AS k, true AS mae_in_range, true AS half_of_the_mean"))
def q_cv_mae(spark, sf):
    """The error over the folds, and that it is less than half of what the mean label
    of the other folds would make (labels follow the snippets, so a fit finds them)."""
    ex = examples(spark, sf)
    prepared, folds = M.prepare(ex), materialize(training.kfold_assign(ex).select("hash", "fold"), "folds")
    k, mae = M.cv_mae(prepared, folds)
    return spark.createDataFrame([(int(k), 0.0 <= mae <= 1.0, 2 * mae < M.mean_mae(prepared, folds))],
                                 "k long, mae_in_range boolean, half_of_the_mean boolean")


@register("save_model", O.with_views("SELECT commit_id, true AS same_score FROM commits", "commits"))
def q_save_model(spark, sf):
    """The saved and reloaded model scores every commit as the fitted one."""
    model, _ = trained_model(spark, sf)
    path = scratch_path(spark, "risk-model")
    M.save_model(model, path)
    c = M.text_table(fx.commits(spark, sf), "code_content", "commit_id")
    again = M.model_score(M.load_model(spark, path), c).select("commit_id", F.col("model_score").alias("again"))
    return M.model_score(model, c).join(again, "commit_id").select("commit_id", (F.col("model_score") == F.col("again")).alias("same_score"))


@register("model_flow", O.with_views(
    f"SELECT commit_id, true AS score_kept, true AS final_at_least_model FROM commits WHERE NOT {O.is_blank_sql('code_content')}", "commits"))
def q_model_flow(spark, sf):
    """The fitted model's scores through routing and the verdict merge."""
    from ..operators import store, verdicts
    from . import analyze
    model, _ = trained_model(spark, sf)
    c = tm.spread(fx.commits(spark, sf), "commit_id")
    scores = materialize(M.model_score(model, c).select("commit_id", F.col("model_score").alias("custom_score")), "model-scores")
    s = scan.with_commit_hash(store.drop_blank_code(c))
    r = routing.route_llm(analyze.routing_table(s, scores), "custom_score", trained=True)
    m = verdicts.merge_verdicts(analyze.routed_findings(s, r), verdicts.llm_verdict_ingest(fx.llm_responses(spark, sf)), trained=True)
    return m.join(scores.withColumnRenamed("custom_score", "given"), "commit_id").select(
        "commit_id", (F.col("custom_model_score") == F.round("given", 4)).alias("score_kept"),
        (F.col("risk_score") >= F.round("given", 4)).alias("final_at_least_model"))
