"""Golden rows (FIXTURES.md §4): hand-computed values of the source system."""

from pyspark.sql import functions as F

from riskloom.functions.features import FEATURE_NAMES, heuristic_score, with_features
from riskloom.functions.scalars import commit_hash, mock_tx_hash, risk_percentage, risk_status, risk_tier
from riskloom.operators import scan
from riskloom.operators.training import kfold_k
from riskloom.operators.verdicts import parse_reviewer_reply, teacher_score

SAMPLE = 'import os\n\npassword = "1234"\n\nos.system("ls")'
ADD = "def add(a, b):\n    return a + b\n"


def one(spark, code):
    return spark.createDataFrame([(1, code)], "commit_id long, code_content string")


def test_sample_hash_floor_and_decision(spark):
    df = scan.with_findings(one(spark, SAMPLE)).withColumn("h", commit_hash(F.col("code_content")))
    r = df.select("h", "pattern_floor", "vulnerabilities", "code_content",
                  risk_percentage(F.col("pattern_floor")).alias("pct"),
                  risk_status(F.col("pattern_floor")).alias("status")).first()
    assert len(r["code_content"]) == 45 and r["h"] == "952957c8722859e3"
    assert r["pattern_floor"] == 0.95
    assert r["vulnerabilities"] == ["[Pattern Match] Remote Code Execution: os.system("]
    assert r["pct"] == 95.0
    assert r["status"] == "Rollback Enforced"
    tx = df.select(mock_tx_hash(F.col("h"), F.lit(95.0), F.lit("Rollback Enforced")).alias("tx")).first()["tx"]
    assert tx == "83e38faf2cce1476"


def test_clean_code(spark):
    r = scan.with_findings(one(spark, ADD)).select(
        commit_hash(F.col("code_content")).alias("h"), "pattern_floor", "vulnerabilities").first()
    assert r["h"] == "ba1a531f581d2e60"
    assert r["pattern_floor"] == 0.0
    assert r["vulnerabilities"] == ["No vulnerabilities detected by pattern analysis"]
    tx = one(spark, ADD).select(mock_tx_hash(commit_hash(F.col("code_content")), F.lit(0.0),
                                             F.lit("Accepted")).alias("tx")).first()["tx"]
    assert tx == "8428b3e72f578596"


def test_findall_group_and_empty_evidence(spark):
    r = scan.with_findings(one(spark, "subprocess.run(cmd, shell=True)")).first()
    assert r["evidence"][0]["matches"] == ["run"]
    r = scan.with_findings(one(spark, "subprocess.run(cmd,\n shell=True)")).first()
    assert r["pattern_floor"] == 0.0
    r = scan.with_findings(one(spark, "-----BEGIN PRIVATE KEY-----")).first()
    assert r["pattern_floor"] == 0.8 and r["evidence"][0]["matches"] == [""]


def test_unanchored_secret_and_unicode_space(spark):
    r = scan.with_findings(one(spark, "task-" + "a" * 32)).first()
    assert r["evidence"][0]["category"] == "Hardcoded Secrets"
    r = scan.with_pattern_floor(one(spark, "os.system (x)")).first()
    assert r["pattern_floor"] == 0.95


def test_features_and_heuristic(spark):
    f = with_features(one(spark, SAMPLE)).first()
    got = [round(f[c], 4) for c in FEATURE_NAMES]
    assert got == [0.95, 0.4, 0.01, 0.0045, 0.0, round(1 / 3, 4), 0.0, 0.0]
    h = with_features(one(spark, SAMPLE)).select(
        heuristic_score(F.col("f_max_severity"), F.col("f_hits")).alias("h")).first()["h"]
    assert h == 0.785


def test_reviewer_reply_parse(spark):
    txt = "RISK_SCORE: 0.92\nREASONING: bad\nVULNERABILITIES:\n- eval of input\n- None\n-\n- os"
    r = spark.createDataFrame([(txt,)], "c string").select(parse_reviewer_reply(F.col("c")).alias("v")).first()["v"]
    assert r["score"] == 0.92
    assert r["vulnerabilities"] == ["eval of input", "None", "os"]
    cases = ["RISK_SCORE: 1.7", "RISK_SCORE: [0.85]", "RISK_SCORE: -0.5", "", "RISK_SCORE: 0.85."]
    rows = spark.createDataFrame([(c,) for c in cases], "c string") \
        .select(parse_reviewer_reply(F.col("c"))["score"].alias("s")).collect()
    assert [r["s"] for r in rows] == [1.0, 0.5, 0.5, 0.5, None]


def test_teacher_score_missing_reply(spark):
    rows = spark.createDataFrame([("0.42",), (None,), ("nothing",)], "c string") \
        .select(teacher_score(F.col("c")).alias("s")).collect()
    assert [r["s"] for r in rows] == [0.42, None, None]


def test_tiers(spark):
    rows = spark.createDataFrame([(49.9,), (50.0,), (74.9,), (75.0,)], "p double") \
        .select(risk_tier(F.col("p")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["Low", "Medium", "Medium", "High"]


def test_kfold_k():
    assert [kfold_k(n) for n in (4, 8, 20, 100)] == [2, 2, 5, 5]
