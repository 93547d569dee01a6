"""Whole runs, bundles, streams and operators that the catalogue doesn't cover."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, compare, models, names, ordered, splits
from tessera.plans import training
from tessera.sources import images, tables
from tessera.streaming import arrivals


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(0)
    rows = [((rng.normal(0, 1, 6) + [i % 2, 0, 0, 0, 0, 0]).tolist(), int(i % 2), f"g{i // 3}", "mid" if i % 4 == 1 else "dal" if i % 2 else "real") for i in range(900)]
    return spark.createDataFrame(rows, "f array<double>, label int, group_key string, generator string").repartition(4).cache()


def test_training_run(spark, features, tmp_path):
    run = training.train(features, models.boosted(8, 3))
    assert run.report["auc"] > 0.6 and 0 < run.threshold < 1 and run.report["calibration"] in models.KINDS
    assert splits.leaks(run.parts, "group_key").first()["leaking"] == 0
    tables.save_bundle(spark, str(tmp_path / "bundle"), run.model, {"threshold": run.threshold}, {"reference": run.reference})
    model, scalars, back = tables.load_bundle(spark, str(tmp_path / "bundle"), ("reference",))
    assert scalars["threshold"] == run.threshold and back["reference"].count() == 6
    rows = models.with_vector(features)
    assert abs(models.scored(model, rows).agg(F.sum("p")).first()[0] - models.scored(run.model, rows).agg(F.sum("p")).first()[0]) < 1e-9
    scored = models.scored(run.model, rows).withColumn("y", F.col("label"))
    out = training.final_test(scored, run.threshold, run.parts.where("part = 'train'"))
    r = out["rates"].first()
    assert r.accuracy_low < r.accuracy < r.accuracy_high and not out["contamination"].first()["clean"]
    assert out["sweep"].count() == 6


def test_models_compared(features):
    got = training.compared(features, {"lr": models.logistic(900, 100), "rf": models.forest(10, 4)}).collect()
    assert {r.model for r in got} == {"lr", "rf"} and all(r.auc > 0.55 for r in got)


def test_tree_contributions_add_up(features):
    rows = models.with_vector(features)
    model = models.boosted(5, 3).fit(rows)
    some = rows.limit(30)
    got = models.ledger(models.tree_contributions(model, models.scored(model, some)), 3).select("total", "p", "top_sum", "rest_sum", "base").collect()
    for r in got:
        assert abs(1 / (1 + np.exp(-r.total)) - r.p) < 1e-9 and abs(r.base + r.top_sum + r.rest_sum - r.total) < 1e-9
    forest = models.forest(5, 3).fit(rows)
    for r in models.ledger(models.tree_contributions(forest, models.scored(forest, some))).collect():
        assert abs(r.total - r.p) < 1e-6


def test_single_cuts(spark):
    cut = lambda rows: compare.best_cut(spark.createDataFrame(rows, "x double, label int"), "x").first()["accuracy"]
    assert cut([(1.0, 0)] * 3 + [(1.0, 1)]) == 0.75
    assert cut([(float(v), 0) for v in (450, 480, 500)] + [(float(v), 1) for v in (512, 1024)]) == 1.0


def test_running_sums_with_ties_nulls_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500)))]
    got = ordered.running_sums(spark.createDataFrame(rows, "g int, v double, i int"), "v", {"s": "v"}, descending=True, within=("g",), buckets=7).collect()
    for r in got:
        assert r.s == sum(v for g, v, _ in rows if g == r.g and v >= r.v)
    assert sorted(r.row_number for r in ordered.numbered(spark.range(50).withColumn("x", F.col("id") * 3), "x").collect()) == list(range(1, 51))


def test_medians(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 301), rng.integers(0, 25, 301))] + [(9, 2.0), (8, None), (7, 1.0), (7, 4.0)]
    got = {r.g: r["median"] for r in ordered.medians(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).collect()}
    assert got == {g: float(np.median([v for h, v in rows if h == g])) for g in {0, 1, 2, 3, 7, 9}}


def test_audit_and_resumption(spark):
    columns = ("auc", "sd_from_chance", "extension_share", "table_share", "resolution_gap", "resolution_cut", "density_gap", "density_cut")
    rows = [(0.5, 0.0, 0.0, 0.0, 1.0, 0.5, 1.0, 0.5), (0.6, 3.0, 0.0, 0.0, 1.0, 0.5, 1.0, 0.5), (0.9, 9.0, 0.9, 0.5, 2.0, 0.95, 1.0, 0.95)]
    facts = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    assert [(r.problems, r.verdict) for r in audit.verdict(facts).orderBy("auc").collect()] == [(0, "clean"), (0, "residual"), (5, "problems")]
    stems = spark.createDataFrame([("a", "a.jpg"), ("A", "b.png"), ("a", "c.png")], "stem string, path string")
    assert sorted(r.target for r in names.renamed(stems).collect()) == ["A__2", "a", "a__3"]
    files = spark.createDataFrame([("x", 320, 320), ("y", 320, 320)], "path string, width int, height int")
    assert images.already_normalised(files).first()["normalised"]
    outcome = spark.createDataFrame([(0, "written"), (1, "failed"), (1, "written")], "label int, outcome string")
    assert {(r.label, r.written, r.failed) for r in images.run_counters(outcome).collect()} == {(0, 1, 0), (1, 1, 1), (None, 2, 1)}
    lines = spark.createDataFrame([("SCORE 0.73",), ("noise",), ("VERDICT: AI",)], "value string")
    assert {(r.key, r.text) for r in tables.machine_lines(lines).collect()} == {("SCORE", "0.73"), ("VERDICT", "AI")}


def test_thinning_keeps_originals(spark):
    rows = spark.range(1000).withColumn("extra", F.col("id") % 2 == 0)
    got = splits.thinned(rows, F.col("extra"), "id", 0.3)
    assert got.where("not extra").count() == 500 and got.where("extra").count() == 150


def test_stream_of_scores(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") / 20).alias("p"), F.timestamp_seconds(F.col("id") * 600).alias("modified"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = arrivals.judged(arrivals.arriving_features(spark, str(tmp_path / "in"), "p double, modified timestamp"), 0.5)
    arrivals.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("verdict = 'AI'").count() == 10
    arrivals.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    hours = arrivals.hourly_share(arrivals.arriving_features(spark, str(tmp_path / "in"), "p double, modified timestamp"), 0.5)
    assert hours.isStreaming


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(k.startswith('op') for k in e.queries()) and 'pipeline' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_container_audit_finds_an_encoder(spark):
    rows = [(f"a_{i}.jpg", i % 2, 1000 + i, "JPEG", 500, 400, f"q{i % 2}", 3.0, 9.0, "4:2:0", None, f"a_{i}", f"a_{i}", "jpg", False, 200_000, 1.25, (1000 + i) / 200_000) for i in range(120)]
    rows.append(("b.jpg", 0, 10, None, None, None, None, None, None, None, "unknown container", "b", "b", "jpg", False, None, None, None))
    probes = spark.createDataFrame(rows, "path string, label int, size long, format string, width int, height int, qhash string, q_dc double, q_mean double, subsampling string, error string, stem string, source string, ext string, augmented boolean, area int, aspect double, bpp double")
    found = audit.container_audit(probes, k=3, rounds=3)
    v = found["verdict"].first()
    assert v.is_tables_exclusive and v.is_cue_uninterpretable and not v.is_extensions_exclusive and v.verdict == "problems"
    assert found["unreadable"].count() == 1 and found["cue"].count() == 3 and found["crosstabs"].where("property = 'qhash' and exclusive").count() == 2


def test_many_ranges(spark):
    bounds = sorted({float(v) for v in np.random.default_rng(2).integers(0, 10_000, 300)})
    rows = spark.range(500).select((F.col("id") * 20.5).alias("x"))
    got = rows.select("x", ordered._place(F.col("x"), bounds).alias("n")).collect()
    assert all(r.n == sum(b <= r.x for b in bounds) for r in got)
    words = spark.createDataFrame([(w,) for w in ("b", "a", None, "c", "a", "ab")], "w string")
    assert {(r.w, r.code) for r in names.ordinal(words, "w", "code").collect()} == {("a", 0), ("ab", 1), ("b", 2), ("c", 3), (None, 4)}
    many = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("w"))
    want = {w: i for i, w in enumerate(sorted(r.w for r in many.collect()))}
    assert {r.w: r.code for r in names.ordinal(many, "w", "code").collect()} == want


def test_magnitudes_as_text(spark):
    values = [0.0, float("nan"), 1.0, 1234.5678, 9999.6, 12345.678, 99999.0, 123456.0, 0.0012345, 0.00099, -2.5, 1000.0, 0.1]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(names.magnitude(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == ["0", "-", "1", "1,235", "1e+04", "1.235e+04", "1e+05", "1.23e+05", "0.001235", "9.90e-04", "-2.5", "1,000", "0.1"]


def test_places_in_a_file(spark, tmp_path):
    (tmp_path / "names.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
    rows = tables.read_names(spark, str(tmp_path / "names.txt"), place=True).collect()
    assert len(rows) == 3000 and all(r.path == f"line {r.pos}" for r in rows)


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_places_over_part_files_of_different_sizes(spark, tmp_path, split):
    """Feature and name files whose sizes are in opposite order, whole and cut into many blocks."""
    cuts = {"features": (0, 4, 30, 90, 100), "names": (0, 60, 75, 80, 100)}
    for kind, at in cuts.items():
        (tmp_path / kind).mkdir()
        for part, (a, z) in enumerate(zip(at, at[1:])):
            lines = [",".join(map(str, (float(i), 0.5, i % 2))) if kind == "features" else f"name {i}" for i in range(a, z)]
            (tmp_path / kind / f"part-{part:05d}.csv").write_text("".join(x + "\n" for x in lines))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        features = tables.read_features(spark, str(tmp_path / "features"), labelled=True, width=2, place=True)
        names_ = tables.read_names(spark, str(tmp_path / "names"), place=True)
        assert sorted((r.pos, r.f[0]) for r in features.collect()) == [(i, float(i)) for i in range(100)]
        got = tables.joined_by_position(features, names_).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 100 and all(r.path == f"name {int(r.f[0])}" and r.label == int(r.f[0]) % 2 for r in got)
    with pytest.raises(ValueError):
        tables.joined_by_position(features.drop("pos"), names_)
