"""Queries: base statistics, texture, spectra, geometry and class comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planes as pl
from ..operators import compare, stats
from . import bindings as b
from .bindings import FILES, MEASURES, PX, RGB, query

R6 = lambda x: f"round({x}, 6) + 0e0"
R9 = lambda x: f"round({x}, 9) + 0e0"


def _moments_sql(source: str, keys: str, x: str = "x") -> str:
    """Base statistics of groups, from explicit moments."""
    return f"""
m AS (SELECT {keys}, count(*) AS n, avg({x}) AS mu, min({x}) AS lo, max({x}) AS hi, avg({x} * {x}) AS energy, var_samp({x}) AS v1 FROM {source} GROUP BY {keys}),
c AS (SELECT {keys}, avg(pow({x} - mu, 2)) AS m2, avg(pow({x} - mu, 3)) AS m3, avg(pow({x} - mu, 4)) AS m4 FROM {source} JOIN m USING ({keys}) GROUP BY {keys}),
h AS (SELECT {keys}, bin, count(*)::DOUBLE AS k FROM (SELECT {keys}, CASE WHEN hi > lo THEN least(floor(({x} - lo) / nullif(hi - lo, 0) * 256), 255) ELSE 0 END AS bin FROM {source} JOIN m USING ({keys})) GROUP BY {keys}, bin),
e AS (SELECT {keys}, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy FROM h GROUP BY {keys})
"""


_BASE = ", ".join(f"{R6(e)} AS {n}" for n, e in (("mean", "mu"), ("std", "coalesce(sqrt(v1), 0)"), ("variance", "coalesce(v1, 0)"), ("energy", "energy"), ("entropy", "entropy"), ("skewness", "CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END"), ("kurtosis", "CASE WHEN m2 > 0 THEN m4 / (m2 * m2) ELSE 0 END")))


@query(f"WITH {PX}, {_moments_sql('px', 'img', 'v')} SELECT img, {_BASE} FROM m JOIN c USING (img) JOIN e USING (img)")
def base_stats_px8(spark, sf_dir):
    return b.planes(spark, sf_dir).select("img", *(c.alias(n) for n, c in pl.base_stats(F.col("plane")).items()))


_LI = "li AS (SELECT l_linestatus, l_returnflag, l_extendedprice / 1000 AS x FROM lineitem)"


@query(f"WITH {_LI}, {_moments_sql('li', 'l_linestatus, l_returnflag')} SELECT l_linestatus, l_returnflag, {_BASE} FROM m JOIN c USING (l_linestatus, l_returnflag) JOIN e USING (l_linestatus, l_returnflag)")
def base_stats_lineitem(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", (F.col("l_extendedprice") / 1000).alias("x"))
    return stats.base_stats(rows, "x", ["l_linestatus", "l_returnflag"])


@query(f"WITH {PX}, {_moments_sql('px', 'img', 'v')} SELECT img, {R6('entropy')} AS entropy FROM e")
def hist_entropy(spark, sf_dir):
    rows = b.planes(spark, sf_dir).select("img", F.explode("plane").alias("v"))
    return stats.entropies(rows, "v", ["img"])


@query(f"WITH g AS (SELECT event_type, event_id % 7 AS part, CASE WHEN event_id % 7 = 0 THEN 3e0 ELSE value END AS x FROM events), {_moments_sql('g', 'event_type, part')} SELECT event_type, part, {R6('CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END')} AS skewness, {R6('CASE WHEN m2 > 0 THEN m4 / (m2 * m2) ELSE 0 END')} AS kurtosis FROM m JOIN c USING (event_type, part)")
def guarded_moments(spark, sf_dir):
    part = F.col("event_id") % 7
    rows = b.table(spark, sf_dir, "events").select("event_type", part.alias("part"), F.when(part == 0, 3.0).otherwise(F.col("value")).alias("x"))
    return rows.groupBy("event_type", "part").agg(stats.skewness("x").alias("skewness"), stats.kurtosis("x").alias("kurtosis"))


@query(f"SELECT l_returnflag, {R6('coalesce(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 0)')} AS quantity_price, {R6('coalesce(covar_pop(l_discount, l_tax) / nullif(stddev_pop(l_discount) * stddev_pop(l_tax), 0), 0)')} AS discount_tax, 0e0 AS with_constant FROM lineitem GROUP BY l_returnflag")
def pearson_pairs(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(2.0).alias("one"))
    return rows.groupBy("l_returnflag").agg(stats.pearson("l_quantity", "l_extendedprice").alias("quantity_price"), stats.pearson("l_discount", "l_tax").alias("discount_tax"), stats.pearson("l_tax", "one").alias("with_constant"))


@query(f"WITH {RGB}, w AS (SELECT img, pos, max(CASE WHEN ch = 0 THEN v END) AS r, max(CASE WHEN ch = 1 THEN v END) AS g, max(CASE WHEN ch = 2 THEN v END) AS b FROM rgb GROUP BY img, pos) SELECT img, {R6('covar_pop(r, g) / nullif(stddev_pop(r) * stddev_pop(g), 0)')} AS rg, {R6('covar_pop(r, b) / nullif(stddev_pop(r) * stddev_pop(b), 0)')} AS rb, {R6('covar_pop(g, b) / nullif(stddev_pop(g) * stddev_pop(b), 0)')} AS gb FROM w GROUP BY img")
def global_channel_corr(spark, sf_dir):
    return b.channels(spark, sf_dir).select("img", *(pl.correlation(F.col(x), F.col(y)).alias((x + y).lower()) for x, y in (("R", "G"), ("R", "B"), ("G", "B"))))


# ---------------------------------------------------------------- texture and residuals

_GREY = f"{PX}, grey AS (SELECT img, r, c, greatest(1, least(8, floor(8 * (v + 0.6e0) / 1.2e0) + 1))::INT AS g FROM px), half AS (SELECT a.img, a.g AS i, b.g AS j FROM grey a JOIN grey b ON a.img = b.img AND a.r = b.r AND b.c = a.c + 1), pairs AS (SELECT * FROM half UNION ALL SELECT img, j, i FROM half)"


def _pairs(spark, sf_dir):
    return b.planes(spark, sf_dir).select("img", pl.glcm_pairs(pl.levels(F.col("plane"), -0.6, 0.6), 8, 8).alias("pairs"))


@query(f"WITH {_GREY} SELECT img, i, j, count(*) AS n FROM pairs GROUP BY img, i, j")
def glcm_counts(spark, sf_dir):
    return _pairs(spark, sf_dir).select("img", F.explode("pairs").alias("p")).groupBy("img", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.count("*").alias("n"))


@query(f"""WITH {_GREY}, n AS (SELECT img, i, j, count(*) / 112e0 AS p FROM pairs GROUP BY img, i, j), mu AS (SELECT img, sum(i * p) AS m FROM n GROUP BY img)
SELECT img, {R9('sum(pow(i - j, 2) * p)')} AS contrast, {R9('CASE WHEN sum(pow(i - m, 2) * p) > 1e-12 THEN sum((i - m) * (j - m) * p) / sum(pow(i - m, 2) * p) ELSE 0 END')} AS correlation, {R9('sum(p * p)')} AS energy, {R9('sum(p / (1 + abs(i - j)))')} AS homogeneity FROM n JOIN mu USING (img) GROUP BY img""", places=9)
def glcm_props(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return rows.select("img", *(c.alias(n) for n, c in pl.glcm_properties(F.col("pairs")).items()))


def _stencil_sql(kernel: str) -> str:
    """Weighted sums over a kernel (dr, dc, w), edges replicated."""
    return f"k(dr, dc, w) AS ({kernel}), s AS (SELECT a.img, a.r, a.c, any_value(a.v) AS v, sum(b.v * w) AS x FROM px a JOIN k ON true JOIN px b ON b.img = a.img AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc)) GROUP BY a.img, a.r, a.c)"


_KX = "SELECT * FROM (VALUES " + ", ".join(f"({r}, {c}, {w}e0)" for r, c, w in pl.SOBEL_X) + ")"
_KY = "SELECT * FROM (VALUES " + ", ".join(f"({r}, {c}, {w}e0)" for r, c, w in pl.SOBEL_Y) + ")"
_STATS3 = f"{R6('avg(x)')} AS mean, {R6('stddev_samp(x)')} AS std, {R6('CASE WHEN var_pop(x) > 0 THEN kurtosis_pop(x) + 3 ELSE 0 END')} AS kurtosis"


@query(f"""WITH {PX}, {_stencil_sql(_KX)}, gx AS (SELECT * FROM s), k2(dr, dc, w) AS ({_KY}), gy AS (SELECT a.img, a.r, a.c, sum(b.v * w) AS y FROM px a JOIN k2 ON true JOIN px b ON b.img = a.img AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc)) GROUP BY a.img, a.r, a.c)
SELECT img, {R6('avg(x)')} AS gx_mean, {R6('var_samp(x)')} AS gx_var, {R6('avg(y)')} AS gy_mean, {R6('var_samp(y)')} AS gy_var, {R6('avg(sqrt(x * x + y * y))')} AS gmag_mean, {R6('var_samp(sqrt(x * x + y * y))')} AS gmag_var FROM gx JOIN gy USING (img, r, c) GROUP BY img""")
def sobel_stats(spark, sf_dir):
    rows = b.planes(spark, sf_dir).select("img", pl.stencil(F.col("plane"), 8, 8, pl.SOBEL_X).alias("gx"), pl.stencil(F.col("plane"), 8, 8, pl.SOBEL_Y).alias("gy"))
    rows = rows.withColumn("gmag", F.zip_with("gx", "gy", lambda x, y: F.sqrt(x * x + y * y)))
    return rows.select("img", *(f(F.col(g)).alias(f"{g}_{n}") for g in ("gx", "gy", "gmag") for n, f in (("mean", pl.mean), ("var", pl.variance))))


def _residual_stats(rows):
    x = F.col("x")
    return rows.select("img", pl.mean(x).alias("mean"), F.sqrt(pl.variance(x)).alias("std"), pl.kurtosis(x).alias("kurtosis"))


@query(f"WITH {PX}, {_stencil_sql('SELECT * FROM (VALUES (0, 0, 4e0), (-1, 0, -1e0), (1, 0, -1e0), (0, -1, -1e0), (0, 1, -1e0))')} SELECT img, {_STATS3} FROM s GROUP BY img")
def laplacian_resid(spark, sf_dir):
    return _residual_stats(b.planes(spark, sf_dir).select("img", pl.stencil(F.col("plane"), 8, 8, pl.LAPLACIAN).alias("x")))


@query(f"""WITH {PX}, k AS (SELECT dr, dc FROM (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)), s AS (SELECT a.img, any_value(a.v) - median(b.v) AS x FROM px a JOIN k ON true JOIN px b ON b.img = a.img AND b.r = greatest(0, least(7, a.r + dr)) AND b.c = greatest(0, least(7, a.c + dc)) GROUP BY a.img, a.r, a.c)
SELECT img, {_STATS3} FROM s GROUP BY img""")
def median_resid(spark, sf_dir):
    return _residual_stats(b.planes(spark, sf_dir).select("img", pl.residual(F.col("plane"), pl.median3(F.col("plane"), 8, 8)).alias("x")))


_GK = "SELECT a, b, wa * wb / (SELECT pow(sum(exp(-d * d / 2e0)), 2) FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS d)) FROM (SELECT d AS a, exp(-d * d / 2e0) AS wa FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS d)), (SELECT d AS b, exp(-d * d / 2e0) AS wb FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS d))"


@query(f"WITH {PX}, {_stencil_sql(_GK)}, z AS (SELECT img, v - x AS x FROM s) SELECT img, {_STATS3} FROM z GROUP BY img")
def gauss_resid(spark, sf_dir):
    smooth = pl.stencil(F.col("plane"), 8, 8, pl.gaussian_kernel(1.0))
    return _residual_stats(b.planes(spark, sf_dir).select("img", pl.residual(F.col("plane"), smooth).alias("x")))


# ---------------------------------------------------------------- spectra

_DFT = f"""{PX}, f AS (SELECT u, w FROM (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS w)),
d AS (SELECT img, u, w, sqrt(pow(sum(v * cos(2 * pi() * (u * r + w * c) / 8)), 2) + pow(sum(v * sin(2 * pi() * (u * r + w * c) / 8)), 2)) AS mag FROM px, f GROUP BY img, u, w)"""


@query(f"WITH {_DFT} SELECT img, u::INT AS u, w::INT AS v, {R6('mag')} AS mag FROM d")
def dft_magnitude8(spark, sf_dir):
    rows = b.planes(spark, sf_dir).select("img", F.posexplode(pl.dft_magnitudes(F.col("plane"), 8)).alias("i", "mag"))
    return rows.select("img", F.floor(F.col("i") / 8).cast("int").alias("u"), (F.col("i") % 8).alias("v"), "mag")


@query(f"""WITH {_DFT}, q AS (SELECT img, mag, sqrt(pow(CASE WHEN u < 4 THEN u ELSE u - 8 END, 2) + pow(CASE WHEN w < 4 THEN w ELSE w - 8 END, 2)) AS rad FROM d),
z AS (SELECT img, mag, least(5, greatest(1, floor(rad / (sqrt(32e0) * (1 + pow(2e0, -52))) * 5) + 1))::INT AS ring FROM q), g AS (SELECT img, ring, avg(mag) AS mag FROM z GROUP BY img, ring),
a AS (SELECT vec_id AS img, ring::INT AS ring FROM embeddings, (SELECT unnest(range(1, 6)) AS ring)) SELECT a.img, a.ring, {R6('coalesce(g.mag, 0)')} AS mag FROM a LEFT JOIN g ON g.img = a.img AND g.ring = a.ring""")
def ring_means(spark, sf_dir):
    rows = b.planes(spark, sf_dir).select("img", F.posexplode(pl.ring_means(pl.dft_magnitudes(F.col("plane"), 8), 8, 5)).alias("i", "mag"))
    return rows.select("img", (F.col("i") + 1).alias("ring"), "mag")


_TAPS = ", ".join(f"({k}, {lo!r}::DOUBLE, {(-1) ** (k + 1) * pl.DB4[7 - k]!r}::DOUBLE)" for k, lo in enumerate(pl.DB4))
_DWT = f"""{PX}, taps(k, lo, hi) AS (VALUES {_TAPS}), t AS (SELECT i, CASE WHEN 2 * i + 1 - k < 0 THEN -(2 * i + 1 - k) - 1 WHEN 2 * i + 1 - k > 7 THEN 15 - (2 * i + 1 - k) ELSE 2 * i + 1 - k END AS m, lo, hi FROM taps, (SELECT unnest(range(7)) AS i)),
rows_ AS (SELECT img, i, c, sum(v * lo) AS lo, sum(v * hi) AS hi FROM px JOIN t ON t.m = px.r GROUP BY img, i, c),
bands AS (SELECT img, rows_.i AS i, t.i AS j, sum(rows_.lo * t.lo) AS cA, sum(rows_.hi * t.lo) AS cH, sum(rows_.lo * t.hi) AS cV, sum(rows_.hi * t.hi) AS cD FROM rows_ JOIN t ON t.m = rows_.c GROUP BY img, rows_.i, t.i)"""


@query(f"WITH {_DWT} SELECT img, i::INT AS i, j::INT AS j, {R6('cA')} AS cA, {R6('cH')} AS cH, {R6('cV')} AS cV, {R6('cD')} AS cD FROM bands")
def dwt_l1_bands8(spark, sf_dir):
    bands = pl.wavelet_bands(F.col("plane"), 8)
    rows = b.planes(spark, sf_dir).select("img", F.posexplode(F.arrays_zip(*(c.alias(n) for n, c in bands.items()))).alias("k", "x"))
    return rows.select("img", F.floor(F.col("k") / 7).cast("int").alias("i"), (F.col("k") % 7).alias("j"), *(F.col(f"x.{n}").alias(n) for n in bands))


@query(f"WITH {_DWT}, long AS (SELECT img, band, x FROM (SELECT img, cA, cH, cV, cD FROM bands) UNPIVOT (x FOR band IN (cA, cH, cV, cD))), {_moments_sql('long', 'img, band')} SELECT img, band, {_BASE} FROM m JOIN c USING (img, band) JOIN e USING (img, band)")
def dwt_band_stats8(spark, sf_dir):
    bands = pl.wavelet_bands(F.col("plane"), 8)
    rows = b.planes(spark, sf_dir).select("img", F.explode(F.array(*(F.struct(F.lit(n).alias("band"), c.alias("x")) for n, c in bands.items()))).alias("s")).select("img", "s.band", "s.x")
    return rows.select("img", "band", *(c.alias(n) for n, c in pl.base_stats(F.col("x")).items()))


# ---------------------------------------------------------------- geometry


@query(f"WITH {FILES}, o AS (SELECT doc_id, width, height, floor((width - 256) / 2e0)::BIGINT AS x, floor((height - 256) / 2e0)::BIGINT AS y FROM files WHERE least(width, height) >= 256) SELECT doc_id, x - x % 8 AS left_, y - y % 8 AS top FROM o")
def centre_crop_snap(spark, sf_dir):
    rows = b.file_records(spark, sf_dir).where(F.least("width", "height") >= 256)
    return rows.select("doc_id", pl.crop_origin(F.col("width"), 256).alias("left_"), pl.crop_origin(F.col("height"), 256).alias("top"))


@query(f"WITH {PX} SELECT img, (r // 2)::INT AS i, (c // 2)::INT AS j, {R6('avg(v)')} AS v FROM px GROUP BY ALL")
def chroma_box_half(spark, sf_dir):
    rows = b.planes(spark, sf_dir).select("img", F.posexplode(pl.halved(F.col("plane"), 8, 8)).alias("k", "v"))
    return rows.select("img", F.floor(F.col("k") / 4).cast("int").alias("i"), (F.col("k") % 4).alias("j"), "v")


@query(f"WITH {RGB}, w AS (SELECT img, pos, max(CASE WHEN ch = 0 THEN u END) AS r, max(CASE WHEN ch = 1 THEN u END) AS g, max(CASE WHEN ch = 2 THEN u END) AS b FROM (SELECT *, greatest(0, least(255, floor((v + 0.6e0) / 1.2e0 * 255 + 0.5e0))) AS u FROM rgb) GROUP BY img, pos) SELECT img, pos, floor(0.2989e0 * r + 0.587e0 * g + 0.114e0 * b + 0.5e0)::BIGINT AS y FROM w")
def luma_round(spark, sf_dir):
    grey = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.6) / 1.2 * 255 + 0.5)))
    rows = b.channels(spark, sf_dir).select("img", F.posexplode(F.arrays_zip("R", "G", "B")).alias("pos", "x"))
    return rows.select("img", "pos", pl.luma(grey(F.col("x.R")), grey(F.col("x.G")), grey(F.col("x.B"))).alias("y"))


# ---------------------------------------------------------------- class comparison

_MOM = f"{MEASURES}, k AS (SELECT name, avg(CASE WHEN label = 0 THEN x END) AS m0, avg(CASE WHEN label = 1 THEN x END) AS m1, var_pop(CASE WHEN label = 0 THEN x END) AS v0, var_pop(CASE WHEN label = 1 THEN x END) AS v1 FROM measures GROUP BY name), d AS (SELECT *, greatest(sqrt((v0 + v1) / 2), 1e-12) AS pooled FROM k)"


@query(f"WITH {_MOM} SELECT name, {R6('m0')} AS mean_0, {R6('m1')} AS mean_1, {R6('pooled')} AS pooled, {R6('abs(m1 - m0) / pooled')} AS d FROM d")
def cohens_d(spark, sf_dir):
    return stats.effect_sizes(b.measures(spark, sf_dir)).select("name", "mean_0", "mean_1", "pooled", "d")


_FEAT = f"{PX}, k AS (SELECT (r * 8 + c)::INT AS col0, avg(CASE WHEN label = 0 THEN v END) AS m0, avg(CASE WHEN label = 1 THEN v END) AS m1, var_pop(CASE WHEN label = 0 THEN v END) AS v0, var_pop(CASE WHEN label = 1 THEN v END) AS v1 FROM px GROUP BY 1), d AS (SELECT *, greatest(sqrt((v0 + v1) / 2), 1e-12) AS pooled FROM k)"


def feature_long(spark, sf_dir):
    """(img, label, col0, x)."""
    return b.planes(spark, sf_dir).select("img", "label", F.posexplode("plane").alias("col0", "x"))


@query(f"WITH {_FEAT} SELECT col0, {R6('abs(m1 - m0) / pooled')} AS d FROM d ORDER BY round(abs(m1 - m0) / pooled, 9) DESC, col0 LIMIT 12")
def top_k_features(spark, sf_dir):
    found = stats.effect_sizes(feature_long(spark, sf_dir), "col0").withColumn("order_", F.round("d", 9))
    return stats.top(found, "order_", 12, "col0").select("col0", "d")


_CROSS = "SELECT value, n0, n1, round(100e0 * n0 / nullif((SELECT sum(n0) FROM x), 0), 6) + 0e0 AS pct0, round(100e0 * n1 / nullif((SELECT sum(n1) FROM x), 0), 6) + 0e0 AS pct1, (n0 = 0 OR n1 = 0) AS exclusive FROM x"


@query(f"WITH {FILES}, x AS (SELECT source || ':' || ext AS value, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM files GROUP BY 1) {_CROSS}")
def crosstab_exclusive(spark, sf_dir):
    return compare.crosstab(b.file_records(spark, sf_dir).withColumn("key", F.concat("source", F.lit(":"), "ext")), "key")


@query(f"WITH {FILES}, x AS (SELECT stem AS value, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM files GROUP BY 1) SELECT sum(n0 + n1)::BIGINT AS n, sum(CASE WHEN n0 = 0 OR n1 = 0 THEN n0 + n1 ELSE 0 END)::BIGINT AS exclusive_n, {R6('sum(CASE WHEN n0 = 0 OR n1 = 0 THEN n0 + n1 ELSE 0 END) / sum(n0 + n1)')} AS share FROM x")
def exclusive_share(spark, sf_dir):
    return compare.exclusive_share(b.file_records(spark, sf_dir), "stem")


@query(f"WITH {FILES}, x AS (SELECT source || ':' || n_ AS value, label FROM (SELECT *, bytes // 50 AS n_ FROM files)), v AS (SELECT value, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM x GROUP BY 1), t AS (SELECT * FROM v ORDER BY n0 + n1 DESC, value LIMIT 12) SELECT (SELECT count(*) FROM x) AS n, sum(CASE WHEN n0 = 0 OR n1 = 0 THEN n0 + n1 ELSE 0 END)::BIGINT AS exclusive_n, {R6('sum(CASE WHEN n0 = 0 OR n1 = 0 THEN n0 + n1 ELSE 0 END) / (SELECT count(*) FROM x)')} AS share FROM t")
def exclusive_share_top(spark, sf_dir):
    """Only the 12 commonest values are looked at; the share is of all files."""
    files = b.file_records(spark, sf_dir)
    return compare.exclusive_share(files.withColumn("value", F.concat("source", F.lit(":"), F.floor(F.col("bytes") / 50).cast("string"))), "value", top=12)


_SUM = f"{MEASURES}, k AS (SELECT name, median(CASE WHEN label = 0 THEN x END) AS median_0, avg(CASE WHEN label = 0 THEN x END) AS mean_0, min(CASE WHEN label = 0 THEN x END) AS min_0, max(CASE WHEN label = 0 THEN x END) AS max_0, median(CASE WHEN label = 1 THEN x END) AS median_1, avg(CASE WHEN label = 1 THEN x END) AS mean_1, min(CASE WHEN label = 1 THEN x END) AS min_1, max(CASE WHEN label = 1 THEN x END) AS max_1 FROM measures GROUP BY name)"


@query(f"WITH {_SUM} SELECT name, {', '.join(f'{R6(f'{n}_{k}')} AS {n}_{k}' for k in (0, 1) for n in ('median', 'mean', 'min', 'max'))}, {R6('greatest(median_0, median_1) / nullif(least(median_0, median_1), 0)')} AS gap FROM k")
def numeric_summary_gap(spark, sf_dir):
    return compare.numeric_summary(b.measures(spark, sf_dir)).drop("overlap")


@query(f"WITH {_SUM} SELECT name, greatest(min_0, min_1) <= least(max_0, max_1) AS overlap FROM k")
def range_overlap(spark, sf_dir):
    return compare.numeric_summary(b.measures(spark, sf_dir)).select("name", "overlap")


@query(f"""WITH v AS (SELECT l_extendedprice AS x, count(*) FILTER (l_linestatus <> 'O') AS c0, count(*) FILTER (l_linestatus = 'O') AS c1 FROM lineitem GROUP BY 1),
t AS (SELECT sum(c0) AS n0, sum(c1) AS n1, max(x) AS last FROM v), s AS (SELECT x, sum(c0) OVER (ORDER BY x) AS b0, sum(c1) OVER (ORDER BY x) AS b1 FROM v),
a AS (SELECT n0 + n1 AS n, greatest(n0, n1) / (n0 + n1) AS base, CASE WHEN x < last THEN (b0 + n1 - b1) / (n0 + n1) END AS acc FROM s, t)
SELECT max(n)::BIGINT AS n, {R6('max(base)')} AS base, {R6('greatest(max(base), max(acc), 1 - min(acc))')} AS accuracy FROM a""")
def best_single_threshold(spark, sf_dir):
    return compare.best_cut(b.measures_wide(spark, sf_dir), "price")


_FOLDERS = f"""{FILES}, u AS (SELECT 'A' AS folder, width, height, bytes, ext AS format FROM files WHERE label = 0 UNION ALL SELECT 'B', width + 60, height + 40, bytes, 'jpg' FROM files WHERE label = 1),
g AS (SELECT folder, count(*) AS n, median(width) AS median_width, median(height) AS median_height, avg(width) AS mean_width, avg(height) AS mean_height, min(least(width, height)) AS min_short, max(least(width, height)) AS max_short, count(*) FILTER (least(width, height) < 256) AS small, median(least(width, height)) AS median_short, median(bytes / nullif(width * height, 0)::DOUBLE) AS median_bpp, median(bytes / 1024e0) AS median_kb, count(*) FILTER (lower(format) IN ('jpg', 'jpeg')) AS jpg, count(*) FILTER (lower(format) = 'png') AS png FROM u GROUP BY folder)"""


def _folders(spark, sf_dir):
    rows = b.file_records(spark, sf_dir)
    a = rows.where("label = 0").select(F.lit("A").alias("folder"), "width", "height", "bytes", F.col("ext").alias("format"))
    other = rows.where("label = 1").select(F.lit("B").alias("folder"), (F.col("width") + 60).alias("width"), (F.col("height") + 40).alias("height"), "bytes", F.lit("jpg").alias("format"))
    return compare.folder_stats(a.unionByName(other))


_FOLDER_COLS = ", ".join(f"{R6(c)} AS {c}" for c in ("median_width", "median_height", "median_short", "mean_width", "mean_height", "median_bpp", "median_kb"))


@query(f"WITH {_FOLDERS} SELECT folder, n, min_short, max_short, small, jpg, png, {_FOLDER_COLS} FROM g")
def folder_stats(spark, sf_dir):
    return _folders(spark, sf_dir)


@query(f"""WITH {_FOLDERS}, z AS (SELECT CASE WHEN min(median_short) > 0 THEN max(median_short) / min(median_short) END AS resolution_gap, CASE WHEN min(median_bpp) > 0 THEN max(median_bpp) / min(median_bpp) END AS density_gap, max(small / n) AS small_share, (count(DISTINCT jpg > 0) > 1 OR count(DISTINCT png > 0) > 1) AS format_mismatch FROM g)
SELECT {R6('resolution_gap')} AS resolution_gap, {R6('density_gap')} AS density_gap, {R6('small_share')} AS small_share, format_mismatch, coalesce(resolution_gap >= 1.25, false) AS resolution_bad, coalesce(density_gap >= 1.35, false) AS density_bad, small_share > 0.05 AS small_bad, (coalesce(resolution_gap >= 1.25, false)::INT + coalesce(density_gap >= 1.35, false)::INT + (small_share > 0.05)::INT + format_mismatch::INT) AS problems FROM z""")
def folder_verdict(spark, sf_dir):
    return compare.folder_verdict(_folders(spark, sf_dir))
