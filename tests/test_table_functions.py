"""Table functions called from SQL."""

import numpy as np
import pytest

from tessera.functions import pixels as px
from tessera.operators import sketch
from tessera.plans import folders


@pytest.fixture(scope="module")
def session(spark):
    folders.register(spark)
    return spark


def test_image_variants(session):
    image = np.random.default_rng(1).integers(0, 256, (400, 380, 3)).astype(np.uint8)
    df = session.createDataFrame([(1, bytearray(image.tobytes()), 400, 380, 3), (2, None, 1, 1, 3)], "id int, data binary, height int, width int, channels int")
    df.createOrReplaceTempView("pictures")
    rows = session.sql("SELECT id, v.variant, v.height, v.width, v.data FROM pictures, LATERAL image_variants(data, height, width, channels) v").collect()
    assert {r.variant for r in rows} == set(px.VARIANTS) and {r.id for r in rows} == {1}
    whole = px.from_spark_image(image.tobytes(), 400, 380, 3)
    for r in rows:
        made = px.VARIANTS[r.variant](whole)
        assert (r.height, r.width) == made.shape[:2] and bytes(r.data) == np.ascontiguousarray(made[:, :, ::-1]).tobytes()
    some = session.sql("SELECT v.variant FROM pictures, LATERAL image_variants(data, height, width, channels, 'control,jpeg85') v").collect()
    assert sorted(r.variant for r in some) == ["control", "jpeg85"]
    with pytest.raises(Exception, match="no such variants: blur9"):
        session.sql("SELECT * FROM pictures, LATERAL image_variants(data, height, width, channels, 'blur9') v")


def test_report_rows_of_a_sketch(session):
    rows = [(f"s{i % 3}", (i * 37 % 101) / 101, int(i % 5 > 1)) for i in range(300)] + [(None, 0.5, 1), (None, 0.0, 0)]
    scored = session.createDataFrame(rows, "s string, p double, y int").repartition(3)
    sketch.sketch(scored, sketch.edges(), ["s"]).createOrReplaceTempView("cells")
    got = session.sql("SELECT * FROM reliability_rows(TABLE(cells) PARTITION BY (s), 's', 15)").collect()
    want = sketch.reliability(session.table("cells"), 15, ["s"]).collect()
    key = lambda r: (r.s or "", r.bin, r.n, round(r.mean_p, 12), round(r.mean_y, 12))
    assert sorted(map(key, got)) == sorted(map(key, want))
    sweep = session.sql("SELECT * FROM sweep_rows(TABLE(cells) PARTITION BY (s), 's', array(0.5D, 0.7D))").collect()
    want = sketch.sweep(session.table("cells"), [0.5, 0.7], ["s"]).collect()
    key = lambda r: (r.s or "", r.threshold, r.tp, r.tn, r.fp, r.fn, round(r.accuracy, 12))
    assert sorted(map(key, sweep)) == sorted(map(key, want))
    with pytest.raises(Exception, match="the table lacks"):
        session.sql("SELECT * FROM reliability_rows(TABLE(SELECT s, p FROM VALUES (1, 2) t(s, p)) PARTITION BY (s), 's', 10)")
