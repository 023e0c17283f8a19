"""The stream library: guards, splits, rolling frames over chunks, joins, state machines and their two hosts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators import joins as J
from strandline.operators import metrics as M
from strandline.operators import models as L
from strandline.operators import rolling as R
from strandline.operators import streams as S
from strandline.operators import topk as K
from strandline.sources import tables as T
from strandline.streaming import hosts as H
from strandline.streaming import machines as X


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(4)
    rows = [(d, i, float(5 * i + 1), float(5 * i + 20), 5 * i + 10.5, min(5, 1 + 5 * i // 300), float(v)) for d, s in (("a", 0), ("b", 1)) for i, v in enumerate(rng.standard_normal(300).cumsum() + s)]
    return spark.createDataFrame(rows, "dataset string, window_index long, start_cycle double, end_cycle double, center_cycle double, stage int, x double").withColumn("_at", F.col("window_index") + 1)


def pandas_of(df):
    return df.toPandas().sort_values(["dataset", "window_index"], ignore_index=True)


@pytest.mark.parametrize("rows", [8192, 64])
def test_frames_do_not_depend_on_chunks(stream, rows):
    got = pandas_of(S.framed(stream, ["dataset"], "_at", {"m": R.rolling_median("x", 20), "r": R.trend("x", 20), "d": R.difference("x", 10), "v": R.rolling_mad("x", 20)}, 39, rows))
    for _, g in got.groupby("dataset"):
        x = g["x"].reset_index(drop=True)
        assert np.allclose(g["m"], x.rolling(20, min_periods=1).median())
        now = x.rolling(20).median()
        assert np.allclose(g["r"].to_numpy(float), ((now - now.shift(20)) / 20).to_numpy(float), equal_nan=True)
        assert np.allclose(g["d"], (x - x.shift(10)).fillna(0))
        mad = x.rolling(20, min_periods=1).apply(lambda v: 0 if len(v) < 3 else 1.4826 * np.median(np.abs(v - np.median(v))))
        assert np.allclose(g["v"], mad)


def test_running_sum_and_runs_over_chunks(stream):
    summed = pandas_of(S.running_sum(stream, ["dataset"], "_at", "x", "s", 32))
    assert np.allclose(summed["s"], summed.groupby("dataset")["x"].cumsum())
    flagged = pandas_of(R.runs(stream.withColumn("f", F.col("x") > 0), "f"))
    for _, g in flagged.groupby("dataset"):
        n = 0
        for f, run in zip(g["f"], g["run"], strict=True):
            n = n + 1 if f else 0
            assert n == run


def test_prefix_causality(stream):
    make = {"m": R.rolling_median("x", 20), "t": R.jump("x", 20)}
    full, cut = S.framed(stream, ["dataset"], "_at", make, 19), S.framed(stream.where("window_index < 100"), ["dataset"], "_at", make, 19)
    r = J.max_difference(full, cut, ["dataset", "window_index"], ["m", "t"]).first()
    assert r["n"] == 200 and r["m"] == 0 and r["t"] == 0


def test_guards(spark):
    rows = spark.createDataFrame([(0, 0.0, 10.0, 20.0), (1, 481.0, 490.5, 500.0), (2, 590.0, 599.5, 609.0), (3, 601.0, 610.5, 620.0), (4, 740.0, 750.0, 760.0)], "k int, s double, c double, e double")
    near, crosses, guard = S.guard_nearest(F.col("s"), F.col("c"), F.col("e"))
    got = rows.select("k", S.guard_overlap(F.col("s"), F.col("e")).alias("o"), S.guard_prior(F.col("c")).alias("p"), S.guard_prior(F.col("c"), clamp=True).alias("q"), near.alias("n"), guard.alias("g")).orderBy("k").collect()
    assert [r["o"] for r in got] == [1, 1, 1, 0, 0] and [r["p"] for r in got] == [1, 0, 1, 0, 0] and [r["q"] for r in got] == [0, 0, 1, 0, 0]
    assert [r["n"] for r in got] == [500.0, 500.0, 500.0, 500.0, 1000.0]  # 750 / 500 = 1.5 rounds to even


def test_labels_are_rejected(stream):
    with pytest.raises(ValueError, match="stage"):
        S.forbid_columns(stream)
    assert "stage" not in S.forbid_columns(S.drop_labels(stream)).columns
    with pytest.raises(ValueError, match="repeat"):
        S.assert_unique_key(stream, ["dataset"])


def test_splits_keep_an_embargo(stream):
    got = pandas_of(S.stage_split(stream, gap=8))
    for _, g in got.groupby(["dataset", "stage"]):
        train, held = g[g.part == "train"].window_index, g[g.part == "validation"].window_index
        assert held.min() - train.max() > 8
    parts = pandas_of(S.chrono_split(stream)).groupby("dataset")["part"].value_counts()
    assert parts["a"]["embargo"] == 20


def test_rank_metrics_with_ties(spark):
    rows = [("d", float(s), y, i) for i, (s, y) in enumerate([(1, 0), (1, 1), (2, 0), (2, 1), (3, 1), (0, 0)])]
    df = spark.createDataFrame(rows, "g string, s double, y int, i int")
    pos, neg = [s for _, s, y, _ in rows if y], [s for _, s, y, _ in rows if not y]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert M.auroc(df, ["g"], "s", "y").first()["auroc"] == pytest.approx(brute)
    assert M.cliffs_delta(df, ["g"], "s", "y").first()["cliffs_delta"] == pytest.approx(2 * brute - 1)
    assert M.auroc(df.where("y = 1"), ["g"], "s", "y").first()["auroc"] is None


def test_arrays(spark):
    rng = np.random.default_rng(1)
    x, b = rng.standard_normal(12), rng.standard_normal(12)
    r = spark.createDataFrame([(x.tolist(), b.tolist())], "x array<double>, b array<double>").select(A.quantile(F.col("x"), 0.3).alias("q"), A.mad(F.col("x")).alias("m"), A.correlation_distance(F.col("x"), F.col("b")).alias("c"), A.cosine(F.col("x"), F.col("b")).alias("o"), A.deviation(F.col("x")).alias("d"), A.softmax(F.col("x")).alias("s"), A.jensen_shannon(A.softmax(F.col("x")), A.softmax(F.col("x"))).alias("j")).first()
    assert r["q"] == pytest.approx(np.quantile(x, 0.3)) and r["m"] == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x)))) and r["d"] == pytest.approx(x.std())
    assert r["c"] == pytest.approx(1 - np.corrcoef(x, b)[0, 1]) and r["o"] == pytest.approx(x @ b / np.linalg.norm(x) / np.linalg.norm(b)) and sum(r["s"]) == pytest.approx(1) and r["j"] == pytest.approx(0)


def test_forward_asof_and_spacing(stream):
    got = pandas_of(J.forward_asof(stream, 103, "x"))
    assert got.loc[0, "due_index"] == 21 and math.isnan(got.loc[299, "due_index"])
    top = K.spaced_top(stream, "x", 4, 300.0).toPandas()
    for _, g in top.groupby("dataset"):
        c = sorted(g["center_cycle"])
        assert all(b - a >= 300 for a, b in zip(c, c[1:], strict=False)) and g["pick"].max() <= 4


def test_ridge_and_distance(stream):
    z = stream.withColumn("one", F.lit(1.0)).withColumn("y", 2 * F.col("x") + 1).withColumn("baseline_window", (F.col("end_cycle") <= 500).cast("int"))
    got = {(r["dataset"], r["term"]): r["coefficient"] for r in L.ridge(z, ["dataset"], ["one", "x"], "y").collect()}
    pdf = pandas_of(z)
    a = pdf[pdf.dataset == "a"]
    m = np.stack([np.ones(len(a)), a["x"]], 1)
    assert np.allclose([got["a", "one"], got["a", "x"]], np.linalg.solve(m.T @ m + np.eye(2), m.T @ a["y"]))
    assert L.mahalanobis(z, ["x", "y"]).where("distance < 0 or distance is null").isEmpty()
    w = z.withColumn("y", F.sin(F.col("x") * 3))
    got, pdf = pandas_of(L.mahalanobis(w, ["x", "y"])), pandas_of(w)
    for d, g in pdf.groupby("dataset"):
        base = g.loc[g["baseline_window"] == 1, ["x", "y"]].to_numpy(float)
        m, n, c = np.median(base, axis=0), len(base), base - base.mean(0)
        cov = c.T @ c / n
        mu = np.trace(cov) / 2
        noise = sum(np.linalg.norm(np.outer(r, r) - cov) ** 2 for r in c) / n / n  # what one row's product is off by
        part = min(1.0, noise / np.linalg.norm(cov - mu * np.eye(2)) ** 2)
        inverse = np.linalg.inv(part * mu * np.eye(2) + (1 - part) * cov)
        want = [np.sqrt(r @ inverse @ r) for r in g[["x", "y"]].to_numpy(float) - m]
        assert np.allclose(got.loc[got["dataset"] == d, "distance"], want)
    assert L.greedy_redundancy(np.array([[1, 0.99, 0.1], [0.99, 1, 0.97], [0.1, 0.97, 1]]), [0, 1, 2]) == [1.0, 0.5, 0.5]


def test_rank_and_risk_heads(spark):
    rng = np.random.default_rng(3)
    d = rng.standard_normal((300, 2)) + [0.8, 0.0]
    w = L.rank_head(spark.createDataFrame(d.tolist(), "a double, b double"), ["a", "b"])
    assert w["a"] > 5 * abs(w["b"]) and abs(w["a"]) + abs(w["b"]) == pytest.approx(1)
    x = rng.standard_normal((300, 2))
    rows = [(float(a), float(-b), float(1 / (1 + np.exp(-2 * a - b))), 1.0) for a, b in x]
    _, beta = L.risk_head(spark.createDataFrame(rows, "a double, b double, y double, w double"), ["a", "b"], "y", "w", 0.001)
    assert 0.5 < beta["a"] <= 5 and beta["b"] >= -1e-9  # the second effect is negative and is held at its bound


def test_sources(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    n = 10
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write(",".join(["CycleIndex", "Stage1to5", *(f"{c}_p{i:04d}" for c in ("Fx", "Fy", "Fz") for i in range(1, n + 1))]) + "\n")
        f.write(",".join(map(str, [1, 2, *range(30)])) + "\n")
    r = T.wide_waveforms(spark, path, "Exp1").first()
    assert r["fx"] == [4.0, 5.0] and r["fz"] == [24.0, 25.0] and r["stage"] == 2
    warnings: list = []
    assert T.optional_csv(spark, str(tmp_path / "none.csv"), "a int", warnings).count() == 0 and warnings
    df = spark.range(5)
    out = str(tmp_path / "t")
    assert T.write_tolerant(df, out, spark) == "written" and T.write_tolerant(df, out, spark) == "equal"
    with pytest.raises(ValueError):
        T.write_tolerant(spark.range(6), out, spark)
    T.write_json(spark, str(tmp_path / "j"), {"b": 1, "a": [2]})
    assert T.read_json(spark, str(tmp_path / "j")) == {"a": [2], "b": 1}
    assert T.fingerprint(df).first() == T.fingerprint(df.orderBy(F.desc("id"))).first() and T.markdown(df, 1).count("\n") == 2


# ------------------------------------------------------------------ machines


def test_evidence_pauses_in_guards_and_forgives_short_failures():
    e = X.Evidence(5)
    for _ in range(59):
        e.step({"condition": True})
    assert e.step({"condition": False, "guard": True})["success"] == 295
    assert e.step({"condition": False})["failure"] == 5 and e.step({"condition": True})["phase"] == "candidate"
    for _ in range(30):
        e.step({"condition": False})
    assert e.phase == "searching" and e.success == 0
    for _ in range(100):
        e.step({"condition": True})
    assert e.phase == "confirmed" and e.step({"condition": False})["phase"] == "confirmed"


def test_freeze_machine_priorities():
    m = X.FreezeMachine(freeze=20, safe=3, extend=5)
    assert m.step({"window_index": 0, "end_cycle": 20})["mode"] == "CALIBRATION"
    first = m.step({"window_index": 200, "end_cycle": 1020, "tes": True})
    assert (first["mode"], first["event"], first["freeze_until"]) == ("FROZEN_EVENT", "ENTER_STATE", 220)
    assert m.step({"window_index": 201, "end_cycle": 1025, "sustained_rs": True})["event"] == "" and m.reason == "TES_EVENT"
    longer = m.step({"window_index": 206, "end_cycle": 1050, "sustained_rs": True})  # extends enough: the reason stays
    assert (longer["event"], longer["reason"], longer["freeze_until"]) == ("EXTEND_FREEZE", "TES_EVENT", 226)
    risk = m.step({"window_index": 207, "end_cycle": 1055, "high_risk": True})
    assert (risk["event"], risk["reason"], risk["mode"], risk["freeze_until"]) == ("EXTEND_FREEZE", "HIGH_RISK", "FROZEN_RISK", 227)
    out = [m.step({"window_index": i, "end_cycle": 5.0 * i}) for i in range(227, 232)]
    assert [o["mode"] for o in out] == ["FROZEN_RISK", "ACTIVE_MONITOR", "ACTIVE_MONITOR", "ACTIVE_UPDATE", "ACTIVE_UPDATE"]  # its last window is frozen, too
    assert [o["event"] for o in out] == ["", "EXIT_FREEZE", "", "", ""]


def test_freeze_machine_enters_once_under_a_lasting_reason():
    m = X.FreezeMachine()
    events = [m.step({"window_index": i, "end_cycle": 1000.0 + i, "high_risk": True})["event"] for i in range(100)]
    assert events.count("ENTER_STATE") == 1


def test_backfill_carries_state_over_batches(spark):
    rng = np.random.default_rng(9)
    rows = [(d, i, bool(rng.random() < 0.7), bool(rng.random() < 0.1)) for d in ("a", "b", None) for i in range(400)]
    frame = spark.createDataFrame(rows, "dataset string, window_index long, condition boolean, guard boolean").orderBy(F.rand(3))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = H.backfill(frame, ["dataset"], "window_index", X.Evidence, "dataset string, window_index long, success double, failure double, phase string", ["success", "failure", "phase"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for d in ("a", "b", None):
        m = X.Evidence()
        want |= {(d, i): m.step({"condition": c, "guard": g}) for e, i, c, g in rows if e == d}
    assert {(r["dataset"], r["window_index"]): (r["success"], r["failure"], r["phase"]) for r in got} == {k: (v["success"], v["failure"], v["phase"]) for k, v in want.items()}


def test_discovery_needs_persistence():
    def last(levels):
        m = X.RegimeDiscovery()
        return [m.step({"level": v}) for v in levels][-1]["stage"]

    noise = np.random.default_rng(0).normal(0, 0.1, 400)
    assert last(noise) == 1
    assert last(noise + np.where(np.arange(400) > 200, 3.0, 0)) == 2
    assert last(noise + np.where(np.arange(400) == 200, 30.0, 0)) == 1


def test_filter_and_prototypes_keep_order():
    f = X.ForwardFilter()
    out = [f.step({"observation": [0.01, 0.96, 0.01, 0.01, 0.01]}) for _ in range(5)]
    assert out[-1]["stage"] == 2 and abs(sum(out[-1]["posterior"]) - 1) < 1e-12
    p = X.OrderedPrototypes([0.0, 1.0, 2.0], least=0.3)
    for _ in range(500):
        p.step({"level": 5.0})
    assert p.centres == sorted(p.centres)


def test_both_hosts_agree(spark, stream, tmp_path):
    rows = stream.select("dataset", "window_index", (F.col("x") > 0).alias("condition"))
    schema = "dataset string, window_index long, success double, failure double, phase string"
    columns = ["success", "failure", "phase"]
    batch = pandas_of(H.backfill(rows, ["dataset"], "window_index", X.Evidence, schema, columns))
    src = str(tmp_path / "in")
    for k, part in enumerate(("window_index < 120", "window_index >= 120")):
        rows.where(part).coalesce(1).write.parquet(f"{src}/{k}")
    out = H.streaming(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src), ["dataset"], "window_index", X.Evidence, schema, columns)
    got: list[pd.DataFrame] = []
    q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.append(df.toPandas())).trigger(availableNow=True).start()
    q.awaitTermination(240)
    online = pd.concat(got).sort_values(["dataset", "window_index"], ignore_index=True)
    assert len(online) == len(batch) and (online["phase"] == batch["phase"]).all() and np.allclose(online["success"], batch["success"])


def test_entry_imports_without_the_training_data_package(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("strandline.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [m for m in sys.modules if m.startswith("strandline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    importlib.reload(entry)
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and "pipeline" not in entry.queries() and len(entry.queries()) > 60
    assert set(entry.oracle_sql()) <= set(entry.queries())
