"""Tasks hand on pixels in small frames, however many images a batch or partition has."""

import numpy as np
import pandas as pd
import pytest

from tessera.plans import catalog_models
from tessera.sources import images


@pytest.fixture
def frames_of(monkeypatch):
    """The frames a job's Python function makes; nothing is run on Spark."""

    def run(made, batch: pd.DataFrame) -> list[pd.DataFrame]:
        got = []

        def caught(df, f, schema):
            got.extend(f(iter([batch])))
            return df

        monkeypatch.setattr(type(made.df), "mapInPandas", caught)
        made()
        return got

    return run


def pixels(n: int, side: int) -> pd.DataFrame:
    data = np.random.default_rng(0).integers(0, 256, (side, side, 3), np.uint8).tobytes()
    return pd.DataFrame([(f"p{i}", side, side, 3, data) for i in range(n)], columns=["path", "height", "width", "n_channels", "data"])


class Job:
    def __init__(self, df, call):
        self.df, self.call = df, call

    def __call__(self):
        return self.call(self.df)


def held(frame: pd.DataFrame, column: str = "data") -> int:
    return sum(len(x) for x in frame[column] if x is not None)


def test_edits_are_handed_on_in_small_frames(spark, frames_of):
    batch = pixels(40, 460)
    df = spark.createDataFrame([], "path string, height int, width int, n_channels int, data binary")
    ready = batch.assign(variant="control", quality=80, factor=0.7, qualities_=[[80]] * 40, factors_=[[0.7]] * 40)
    got = frames_of(Job(df, lambda x: images.edited(x, ["control"])), ready)
    assert sum(map(len, got)) == 40 and max(map(held, got)) <= (1 << 24) + 460 * 460 * 3


def test_made_images_are_handed_on_in_small_frames(spark, frames_of, monkeypatch):
    batch = pd.DataFrame({"img": range(40), "label": [0, 1] * 20, "plane": [np.linspace(-0.5, 0.5, 64)] * 40})
    df = spark.createDataFrame([], "img long, label int, plane array<double>")
    monkeypatch.setattr(catalog_models.b, "planes", lambda spark, sf_dir: df)
    got = frames_of(Job(df, lambda x: catalog_models.made_images(spark, "")), batch)
    assert sum(map(len, got)) == 40 and max(map(held, got)) <= (1 << 24) + 460 * 460 * 3


def test_each_edit_of_each_image_comes_back(spark):
    df = spark.createDataFrame([(p.path, 1, 90, 90, 3, bytearray(p.data)) for p in pixels(3, 90).itertuples()], "path string, label int, height int, width int, n_channels int, data binary")
    got = images.edited(df, ["control", "jpeg60", "rweb"])
    assert got.columns == ["path", "label", "variant", "quality", "factor", "edit_status", "height", "width", "n_channels", "data"]
    rows = {(r.path, r.variant): r for r in got.collect()}
    assert len(rows) == 9 and all((rows[f"p{i}", "rweb"].edit_status, rows[f"p{i}", "control"].edit_status) == ("TOOSMALL", "DONE") for i in range(3))
    assert bytes(rows["p0", "control"].data) == pixels(1, 90).data[0] and 70 <= rows["p0", "jpeg60"].quality <= 95


def test_measuring_sends_no_tiles_and_no_sums(spark):
    df = spark.createDataFrame([(p.path, 90, 90, 3, bytearray(p.data)) for p in pixels(3, 90).itertuples()], "path string, height int, width int, n_channels int, data binary")
    plan = images.measured(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
