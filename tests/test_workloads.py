import json
import struct

import numpy as np
import pytest
from vecloom import workloads as W


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("work")
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(300, 6)).astype(np.float32), rng.normal(size=(8, 6)).astype(np.float32)
    near = np.argsort(((x[None] - q[:, None]) ** 2).sum(2), axis=1)[:, :10].astype(np.int32)
    for name, rows, kind in (("base.fvecs", x, "f"), ("query.fvecs", q, "f"), ("truth.ivecs", near, "i")):
        (d / name).write_bytes(b"".join(struct.pack(f"<i{len(r)}{kind}", len(r), *r) for r in rows))
    return d


def test_verify(spark, files, tmp_path):
    base = ["--base-file", f"{files}/base.fvecs", "--query-file", f"{files}/query.fvecs", "--ground-truth-file", f"{files}/truth.ivecs"]
    out = W.run(spark, ["verify", *base, "--num-queries", "4"])
    assert out["exact_recall"] == 1.0 and out["index_recall"] >= 0.9 and out["exact_below_one"] == []
    out = W.run(spark, ["verify", "--mode", "mutation", *base, "--num-mutations", "12", "--save-summary", str(tmp_path / "s.json")])
    assert out["passed"] and out["checked"] == 12
    assert json.load(open(tmp_path / "s.json")) == out


def test_bench(spark, files, tmp_path):
    base = ["--base-file", f"{files}/base.fvecs", "--query-file", f"{files}/query.fvecs", "--data-dir", str(tmp_path / "db")]
    out = W.run(spark, ["bench", *base, "--num-queries", "3", "--warmup-queries", "1"])
    assert out["n"] == 3 and out["recall"] == 1.0 and (tmp_path / "db/exact_results.json").exists()
    out = W.run(spark, ["bench", "--mode", "mix", *base, "--num-ops", "6"])
    assert out["operations_per_second"] > 0
    out = W.run(spark, ["bench", "--mode", "write", *base, "--num-writes", "5", "--wait-visible", "--preload", "9", "--write-pattern", "update"])
    assert out["write"]["n"] == 5


def test_arguments():
    for argv, said in ((["bench", "--base-file", "x"], "query-file"), (["bench", "--mode", "write", "--base-file", "x", "--write-pattern", "update"], "preload"), (["bench", "--mode", "mix", "--base-file", "x", "--query-file", "x", "--read-write-ratio", "1"], "ratio")):
        with pytest.raises(ValueError, match=said):
            W.run(None, argv)
    assert W.nearest_rank([1, 2, 3, 5], 50) == 3 and W.nearest_rank([], 50) == 0.0
