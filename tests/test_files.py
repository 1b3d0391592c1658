"""Directory scan of code files and the seed-request export."""

import os

from pyspark.sql import functions as F

from riskloom.operators import scan, training
from riskloom.operators.verdicts import seed_requests
from riskloom.session import scratch_path
from riskloom.sources.files import read_code_files


def test_scan_code_files(spark):
    root = scratch_path(spark, "code-tree")
    os.makedirs(os.path.join(root, "pkg", "sub"))
    with open(os.path.join(root, "pkg", "a.py"), "wb") as f:
        f.write(b"import os\r\nos.system(cmd)\r\n")
    with open(os.path.join(root, "pkg", "sub", "b.py"), "wb") as f:
        f.write(b"x = 1\rprint(x)\n")
    with open(os.path.join(root, "pkg", "bad.py"), "wb") as f:
        f.write(b"\xff\xfe not utf8 \xc3\x28")
    with open(os.path.join(root, "pkg", "notes.txt"), "wb") as f:
        f.write(b"skip me")
    files, rejects = read_code_files(spark, root, "*.py")
    got = {os.path.basename(r["path"]): r["code_content"] for r in files.collect()}
    assert got == {"a.py": "import os\nos.system(cmd)\n", "b.py": "x = 1\nprint(x)\n"}
    assert [os.path.basename(r["path"]) for r in rejects.collect()] == ["bad.py"]
    floors = {os.path.basename(r["path"]): r["pattern_floor"]
              for r in scan.with_pattern_floor(files).select("path", "pattern_floor").collect()}
    assert floors == {"a.py": 0.95, "b.py": 0.0}


def test_seed_requests(spark):
    r = seed_requests(training.seeds(spark), training.tiers(spark))
    assert r.count() == 31
    assert r.groupBy("tier").count().count() == 5
    crit = r.where(F.col("tier") == "critical").first()["prompt"]
    assert "0.75" in crit and "1.00" in crit
