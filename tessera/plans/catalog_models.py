"""Queries: models, calibration, explanations and whole-image jobs. SQL can't express these; tests hold them to identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as px
from ..operators import audit, metrics, models, names, ordered, splits, stats
from ..schema import feature_dict
from ..sources import images
from . import bindings as b
from . import folders, training
from .bindings import FILES, PX, SCORED, query
from .catalog_stats import R6, feature_long


#: Sizes of the queries' models.
TREES, ROUNDS = 300, 100


def labelled(spark, sf_dir):
    """(img, label, f, features, part): planes as 64 features, split by a hash of the id."""
    rows = b.planes(spark, sf_dir).select("img", "label", F.col("plane").alias("f"))
    return models.with_vector(splits.split_3way(rows, "img"))


def _fit(spark, sf_dir, pipeline):
    rows = labelled(spark, sf_dir)
    return rows, pipeline.fit(rows.where("part = 'train'"))  # each fit keeps its own input


def _scores(spark, sf_dir, pipeline):
    rows, model = _fit(spark, sf_dir, pipeline)
    return models.scored(model, rows.where("part = 'test'")).select("img", "label", "p")


@query()
def lr_scores(spark, sf_dir):
    n = b.table(spark, sf_dir, "embeddings").count()
    return _scores(spark, sf_dir, models.logistic(n))


@query()
def rf_scores(spark, sf_dir):
    return _scores(spark, sf_dir, models.forest(TREES))


@query()
def gbt_scores(spark, sf_dir):
    return _scores(spark, sf_dir, models.boosted(ROUNDS))


def _slice(spark, sf_dir):
    return b.scored(spark, sf_dir).select("doc_id", "y", "p", "group_key")


@query()
def isotonic_map(spark, sf_dir):
    rows = _slice(spark, sf_dir)
    return models.Calibrated("isotonic", rows).apply(rows).select("doc_id", F.col("p").alias("calibrated"))


@query(f"WITH {SCORED} SELECT count(*) AS rows, true AS monotone, true AS in_range FROM scored")
def isotonic_order(spark, sf_dir):
    """(rows, monotone, in_range): whether calibrated scores keep the order of the raw ones, and are probabilities."""
    rows = _slice(spark, sf_dir)
    both = models.Calibrated("isotonic", rows).apply(rows.withColumn("raw", F.col("p"))).groupBy("raw").agg(F.count("*").alias("n"), F.max("p").alias("hi"), F.min("p").alias("lo"))
    upto = ordered.running_max(both, "raw", "hi")
    return upto.agg(F.sum("n").alias("rows"), F.bool_and(F.col("before").isNull() | (F.col("before") <= F.col("lo") + 1e-9)).alias("monotone"), F.bool_and((F.col("lo") >= 0) & (F.col("hi") <= 1)).alias("in_range"))


@query()
def platt_map(spark, sf_dir):
    rows = _slice(spark, sf_dir)
    return models.Calibrated("sigmoid", rows).apply(rows).select("doc_id", F.col("p").alias("calibrated"))


@query()
def calib_choice(spark, sf_dir):
    best, trials = models.choose_calibration(_slice(spark, sf_dir), "doc_id")
    return trials.select("kind", "ece", (F.col("kind") == best).alias("chosen"))


def _held_out(spark, sf_dir):
    rows = b.planes(spark, sf_dir).select("img", "label", F.col("plane").alias("f"), F.when(F.col("label") == 1, F.concat(F.lit("g"), (F.col("img") % 3).cast("string"))).otherwise("real").alias("generator"))
    return training.leave_one_generator_out(rows, models.forest(TREES), group="img")


@query()
def loo_generator(spark, sf_dir):
    """Leave one generator out, with and without a threshold placed on a slice of it."""
    return _held_out(spark, sf_dir)


@query()
def loo_mean_gain(spark, sf_dir):
    return training.mean_gain(_held_out(spark, sf_dir))


@query()
def best_model(spark, sf_dir):
    """Three models on one grouped split, and the one with the largest AUC."""
    rows = b.planes(spark, sf_dir).select("img", "label", F.col("plane").alias("f"))
    n = rows.count()
    found = training.compared(rows, {"logistic": models.logistic(n), "forest": models.forest(TREES), "boosted": models.boosted(ROUNDS)}, "img")
    best = metrics.best_model(found).select("model", F.lit(True).alias("best"))
    return found.join(F.broadcast(best), "model", "left").select("model", "n", "accuracy", "precision", "recall", "specificity", "f1", "auc", F.coalesce("best", F.lit(False)).alias("best"))


@query()
def sampled_contributions(spark, sf_dir):
    """The explanation of the test rows for a model that isn't made of trees, in probability."""
    rows, model = _fit(spark, sf_dir, models.logistic(500))
    background = splits.exact_sample(rows.where("part = 'train'"), "img", models.BACKGROUND)
    return models.contributions(model, rows.where("part = 'test'").select("img", "f"), background, "img", 64)


@query("SELECT count(*) AS rows, true AS adds_up FROM embeddings")
def sampled_additivity(spark, sf_dir):
    """(rows, adds_up): whether base and sampled contributions make each row's probability, over all rows."""
    rows, model = _fit(spark, sf_dir, models.logistic(500))
    background = splits.exact_sample(rows.where("part = 'train'"), "img", models.BACKGROUND)
    found = models.sampled_contributions(model, rows, background, "img", 64, orders=1)
    both = found.join(models.scored(model, rows).select("img", "p"), "img")
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.count("*").alias("rows"), (F.max(F.abs(total - F.col("p"))) < 1e-9).alias("adds_up"))


@query()
def contributions(spark, sf_dir):
    rows, model = _fit(spark, sf_dir, models.boosted(ROUNDS))
    test = rows.where("part = 'test'").select("img", "f")
    out = models.ledger(models.tree_contributions(model, test), 5)
    return out.select("img", "base", "top_sum", "rest_sum", "total", F.transform("top", lambda t: t["col0"]).alias("top_columns"))


@query("SELECT count(*) AS rows, true AS adds_up FROM embeddings")
def additivity(spark, sf_dir):
    """(rows, adds_up): whether base plus contributions is each score's margin, to 1e-9 of the probability."""
    rows, model = _fit(spark, sf_dir, models.logistic(500))
    test = models.linear_contributions(model, rows)
    test = models.scored(model, test.select("img", "base", "contributions", "features"))
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x)
    return test.agg(F.count("*").alias("rows"), (F.max(F.abs(1 / (1 + F.exp(-total)) - F.col("p"))) < 1e-9).alias("adds_up"))


@query("SELECT count(*) AS rows, true AS adds_up FROM embeddings")
def tree_additivity(spark, sf_dir):
    """(rows, adds_up): the same for boosted trees."""
    rows, model = _fit(spark, sf_dir, models.boosted(ROUNDS))
    out = models.ledger(models.tree_contributions(model, models.scored(model, rows).select("img", "f", "p")))
    return out.agg(F.count("*").alias("rows"), (F.max(F.abs(1 / (1 + F.exp(-F.col("total"))) - F.col("p"))) < 1e-9).alias("adds_up"))


@query()
def feature_importances(spark, sf_dir):
    """The 20 largest of a forest's importances."""
    _, model = _fit(spark, sf_dir, models.forest(TREES))
    return models.top_importances(models.importances(model, 64, spark), 20)


_EVIDENCE = f"""{PX}, l AS (SELECT img, label, (r * 8 + c)::INT AS col0, v AS x FROM px), k AS (SELECT col0, avg(x) FILTER (label = 0) AS m0, avg(x) FILTER (label = 1) AS m1, greatest(sqrt((var_pop(x) FILTER (label = 0) + var_pop(x) FILTER (label = 1)) / 2), 1e-12) AS pooled FROM l GROUP BY col0),
t AS (SELECT * FROM k ORDER BY abs(m1 - m0) / pooled DESC, col0 LIMIT 60), e AS (SELECT img, col0, abs(x - m0) / pooled AS d0, abs(x - m1) / pooled AS d1 FROM l JOIN t USING (col0)), r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY round(abs(d0 - d1), 9) DESC, col0) AS rank FROM e)"""


@query(f"WITH {_EVIDENCE} SELECT img, col0, {R6('d0')} AS distance_real, {R6('d1')} AS distance_ai, rank::INT AS rank, CASE WHEN d1 < d0 THEN 'AI' ELSE 'real' END AS nearer FROM r WHERE rank <= 5")
def class_evidence(spark, sf_dir):
    long = feature_long(spark, sf_dir)
    reference = stats.top(stats.effect_sizes(long, "col0"), "d", 60, "col0")
    return models.class_evidence(long, reference, "img", 5)


@query()
def metadata_classifier(spark, sf_dir):
    """Eleven container columns, five balanced grouped folds."""
    return audit.fold_summary(audit.trivial_cue(images.probes(_jpeg_files(spark, sf_dir)), rounds=ROUNDS))


@query()
def container_audit(spark, sf_dir):
    """The audit end to end over JPEG files' headers: facts, flags and verdict."""
    return audit.container_audit(images.probes(_jpeg_files(spark, sf_dir)), rounds=ROUNDS, every=False)["verdict"]


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH c AS (SELECT unnest(range(230))::INT AS col0), s AS (SELECT ['mean', 'std', 'variance', 'energy', 'entropy', 'skewness', 'kurtosis'] AS base, ['red', 'green', 'blue'] AS ch)
SELECT col0, CASE WHEN col0 < 51 THEN 'A spatial' WHEN col0 < 198 THEN 'B wavelet' WHEN col0 < 218 THEN 'C fft' WHEN col0 < 227 THEN 'D residual' ELSE 'E corr' END AS block,
CASE WHEN col0 < 51 THEN ch[col0 // 17 + 1] WHEN col0 < 198 THEN ch[(col0 - 51) // 49 + 1] WHEN col0 < 227 THEN 'luminance' ELSE {_LIST(("R-G", "R-B", "G-B"))}[col0 - 226] END AS channel,
CASE WHEN col0 < 51 THEN (base || {_LIST(("GLCM contrast", "GLCM correlation", "GLCM energy", "GLCM homogeneity", "mean Gx", "var Gx", "mean Gy", "var Gy", "mean |G|", "var |G|"))})[col0 % 17 + 1] || ' (' || ch[col0 // 17 + 1] || ')'
  WHEN col0 < 198 THEN 'wavelet ' || {_LIST(("cA2", "cH2", "cV2", "cD2", "cH1", "cV1", "cD1"))}[((col0 - 51) % 49) // 7 + 1] || ' ' || base[(col0 - 51) % 7 + 1] || ' (' || ch[(col0 - 51) // 49 + 1] || ')'
  WHEN col0 < 218 THEN 'FFT ring ' || (col0 - 197) || ' of 20'
  WHEN col0 < 227 THEN {_LIST(("Laplacian residual", "median residual", "Gaussian residual"))}[(col0 - 218) // 3 + 1] || ' ' || {_LIST(("mean", "std", "kurtosis"))}[(col0 - 218) % 3 + 1]
  ELSE 'channel correlation ' || {_LIST(("R-G", "R-B", "G-B"))}[col0 - 226] END AS name FROM c, s""")
def feature_dictionary(spark, sf_dir):
    return feature_dict(spark)


@query(f"WITH {PX}, d AS ({b.ORACLES['feature_dictionary']}), l AS (SELECT (r * 8 + c)::INT AS col0, v FROM px) SELECT d.block, d.channel, d.name, count(*) AS n, {R6('avg(v)')} AS mean, {R6('max(v)')} AS largest FROM l JOIN d USING (col0) GROUP BY 1, 2, 3")
def named_features(spark, sf_dir):
    """Measures joined with the layout's dictionary: (block, channel, name, n, mean, largest)."""
    rows = feature_long(spark, sf_dir).join(F.broadcast(feature_dict(spark)), "col0")  # 230 rows
    return rows.groupBy("block", "channel", "name").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("largest"))


# ---------------------------------------------------------------- whole images


#: Images a task is meant to have.
IMAGES = 200


def _spread_planes(spark, sf_dir):
    """(img, label, plane), dealt out for work on images."""
    planes = b.planes(spark, sf_dir)
    # A small file would be one task, and an image takes a tenth of a second; of many images a task has some IMAGES, so its batches don't grow with the table.
    spread = max(spark.sparkContext.defaultParallelism * 4, -(-planes.count() // IMAGES))
    return planes.repartition(spread, "img")


def made_images(spark, sf_dir, side: int = 460):
    """(path, label, height, width, n_channels, data): each embedding's plane enlarged, with texture from its values, as an image."""

    def made(batches):
        for pdf in batches:
            for img, label, plane in zip(pdf["img"], pdf["label"], pdf["plane"], strict=True):
                yield f"img_{img}_{'gen' if label else 'cam'}.png", int(label), side, side, 3, px.grained(plane, int(img), side).tobytes()

    def run(batches):
        return images.frames(made(batches), ["path", "label", "height", "width", "n_channels", "data"], "data")

    return _spread_planes(spark, sf_dir).mapInPandas(run, "path string, label int, height int, width int, n_channels int, data binary")


def images_to_make(spark, sf_dir, side: int = 460):
    """(path, label, height, width, img, plane), and what makes the pixels of made_images() from a row in the task that needs them: none are sent from task to task."""
    name = F.concat(F.lit("img_"), F.col("img").cast("string"), F.when(F.col("label") != 0, "_gen.png").otherwise("_cam.png"))
    rows = _spread_planes(spark, sf_dir).select(name.alias("path"), F.col("label").cast("int").alias("label"), F.lit(side).alias("height"), F.lit(side).alias("width"), "img", "plane")
    return rows, (("img", "plane"), lambda row: px.grained(row["plane"], int(row["img"]), side)[:, :, ::-1])


@query()
def extract230(spark, sf_dir):
    rows, decode = images_to_make(spark, sf_dir, 256)
    return images.measured(rows, decode=decode).select("path", "label", "f", "status")


@query()
def normalise_images(spark, sf_dir):
    rows, decode = images_to_make(spark, sf_dir)
    made = images.edited(images.large_enough(rows), ["normalised"], decode=decode, digest=True)
    return made.select("path", "variant", "height", "width", "digest")


@query()
def augment_variants(spark, sf_dir):
    rows, decode = images_to_make(spark, sf_dir)
    made = images.edited(rows, ["qhi", "qlo", "soft", "rweb"], decode=decode, digest=True)
    return made.select("path", "variant", "quality", "height", "width", "digest")


@query()
def edit_variants(spark, sf_dir):
    rows, decode = images_to_make(spark, sf_dir)
    made = images.edited(images.variant_eligible(rows), list(px.VARIANTS), decode=decode, digest=True)
    return made.select("path", "variant", "height", "width", "digest")


def _jpeg_files(spark, sf_dir):
    """(path, label, size, content): JPEG headers made from documents' sizes."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for doc, stem, w, h, label, size in zip(pdf["doc_id"], pdf["stem"], pdf["width"], pdf["height"], pdf["label"], pdf["bytes"], strict=True):
                q = px.quantisation(60 + int(doc) % 36, False).astype(int).ravel().tolist()
                head = b"\xff\xd8\xff\xdb" + (67).to_bytes(2, "big") + b"\0" + bytes(q) + b"\xff\xc0" + (17).to_bytes(2, "big") + b"\x08" + int(h).to_bytes(2, "big") + int(w).to_bytes(2, "big") + b"\x03\x01" + (b"\x22" if label else b"\x11") + b"\0\x02\x11\0\x03\x11\0\xff\xd9"
                out.append((f"{stem}_{doc}.jpg" if doc % 5 == 0 else f"{doc}_{stem}.jpg", int(label), int(size), head))
            yield pd.DataFrame(out, columns=["path", "label", "size", "content"])

    return b.file_records(spark, sf_dir).mapInPandas(run, "path string, label int, size long, content binary")


_JPEG = f"""{FILES}, j AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN stem || '_' || doc_id ELSE doc_id || '_' || stem END AS s FROM files)"""


@query(f"WITH {_JPEG} SELECT s || '.jpg' AS path, label, 'JPEG' AS format, width, height, CASE WHEN label = 1 THEN '4:2:0' ELSE '4:4:4' END AS subsampling, regexp_matches(s, '_(qhi|qlo|rweb|soft|q85|q60|r75q85)$', 'i') AS augmented, regexp_replace(s, '_(qhi|qlo|rweb|soft|q85|q60|r75q85)$', '', 'i') AS source, 'jpg' AS ext, width * height AS area, {R6('width / greatest(height, 1)')} AS aspect, {R6('bytes / (width * height)::DOUBLE')} AS bpp FROM j")
def jpeg_probe(spark, sf_dir):
    """Header fields and what follows from them, of JPEG files."""
    rows = images.probes(_jpeg_files(spark, sf_dir)).where("error is null")
    return rows.select("path", "label", "format", "width", "height", "subsampling", "augmented", "source", "ext", "area", "aspect", "bpp")


@query()
def jpeg_tables(spark, sf_dir):
    """Quantisation tables of JPEG files: their fingerprint, the first value and the mean."""
    return images.probes(_jpeg_files(spark, sf_dir)).select("path", "qhash", "q_dc", "q_mean")


@query(f"WITH {FILES} SELECT doc_id, stem, lower(ext) AS ext FROM files")
def name_fields(spark, sf_dir):
    rows = b.file_records(spark, sf_dir).withColumn("path", F.concat(F.lit("a\\b/"), "stem", F.lit("."), "ext"))
    return rows.select("doc_id", names.stem_of(F.col("path")).alias("stem"), names.extension_of(F.col("path")).alias("ext"))


@query()
def explained_images(spark, sf_dir):
    """The largest contributions to each image's score, by a boosted model on the 230 features."""
    rows, decode = images_to_make(spark, sf_dir, 256)
    rows = b.written(images.measured(rows, decode=decode).select("path", "label", "f").where("f is not null"), "measured")
    model = models.boosted(ROUNDS).fit(models.with_vector(rows))
    return folders.explain(model, rows, feature_dict(spark), 0.5, 5)
