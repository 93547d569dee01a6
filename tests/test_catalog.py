"""Every query with SQL against DuckDB, and identities for the rest."""

import math

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(catalog.ORACLES[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == cols
    want = sorted((tuple(norm(r[at.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", ["lr_scores", "gbt_scores", "isotonic_map", "platt_map"])
def test_scores_are_probabilities(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    value = "p" if "p" in rows[0] else "calibrated"
    assert rows and all(0 <= r[value] <= 1 for r in rows)


def test_isotonic_map_is_monotone(spark):
    from tessera.plans import bindings

    raw = {r.doc_id: r.p for r in bindings.scored(spark, SF).collect()}
    rows = sorted((raw[r.doc_id], r.calibrated) for r in catalog.QUERIES["isotonic_map"](spark, SF).collect())
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(rows, rows[1:]))


def test_sampled_contributions_add_up(spark):
    rows = {r.img: r for r in catalog.QUERIES["sampled_contributions"](spark, SF).collect()}
    p = {r.img: r.p for r in catalog.QUERIES["lr_scores"](spark, SF).collect()}
    assert set(rows) == set(p)
    for img, r in rows.items():
        assert abs(r.base + sum(r.contributions) - p[img]) < 1e-6 and r.space == "probability" and len(r.contributions) == 64


def test_leave_one_generator_out(spark):
    rows = catalog.QUERIES["loo_generator"](spark, SF).collect()
    assert [r.held_out for r in sorted(rows)] == ["g0", "g1", "g2"]
    assert all(r.n_train and r.n_cal and r.n_eval and 0 <= r.roc_auc <= 1 for r in rows)


def test_one_calibration_is_chosen(spark):
    rows = catalog.QUERIES["calib_choice"](spark, SF).collect()
    assert len(rows) == 3 and sum(r.chosen for r in rows) == 1
    assert min(r.ece for r in rows) == next(r.ece for r in rows if r.chosen)


def test_balanced_folds(spark):
    rows = catalog.QUERIES["balanced_fold_counts"](spark, "/root/testdata/sf0.01").collect()
    sizes = {}
    for r in rows:
        sizes[r.fold] = sizes.get(r.fold, 0) + r.n
    assert len(sizes) == 5 and max(sizes.values()) < 1.3 * min(sizes.values())
