"""Queries: metrics of scores, names and sets, splits, shift and audit rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as functions
from ..operators import audit, compare, metrics, names, ordered, sketch, splits, stats
from ..sources import images, tables
from . import bindings as b
from . import folders
from .bindings import FILES, LOGS, PX, SCORED, query
from .catalog_stats import R6, feature_long

_T = 0.5

# ---------------------------------------------------------------- rank metrics


@query(f"WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS k FROM scored), s AS (SELECT sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0, sum(CASE WHEN y = 1 THEN k ELSE 0 END) AS r1 FROM r) SELECT n1, n0, {R6('(r1 - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0)')} AS auc FROM s")
def roc_auc_rank(spark, sf_dir):
    return metrics.roc_auc(b.scored(spark, sf_dir))


@query(f"WITH {SCORED} SELECT doc_id, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rank_ FROM scored")
def average_ranks(spark, sf_dir):
    return metrics.average_ranks(b.scored(spark, sf_dir)).select("doc_id", "rank_")


_CURVE = f"{SCORED}, t AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p), c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS n1, sum(neg) OVER () AS n0 FROM t)"


@query(f"WITH {_CURVE} SELECT {R6('p')} AS p, tp::BIGINT AS tp, fp::BIGINT AS fp, {R6('tp / n1')} AS tpr, {R6('fp / n0')} AS fpr FROM c")
def roc_curve_points(spark, sf_dir):
    return metrics.roc_curve(b.scored(spark, sf_dir))


@query(f"WITH {_CURVE} SELECT {R6('p')} AS threshold, {R6('tp / n1 - fp / n0')} AS j FROM c ORDER BY round(tp / n1 - fp / n0, 12) DESC, p DESC LIMIT 1")
def youden_threshold(spark, sf_dir):
    return metrics.youden(b.scored(spark, sf_dir))


@query("SELECT event_id, sum(1) OVER (ORDER BY value, event_id)::BIGINT AS place, round(sum(value) OVER (ORDER BY value, event_id), 4) + 0e0 AS upto FROM events")
def running_totals(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select("event_id", "value")
    return ordered.running_sums(rows, "value", {"place": F.lit(1), "upto": "value"}, ties=("event_id",)).select("event_id", "place", F.round("upto", 4).alias("upto"))


# ---------------------------------------------------------------- counts and calibration

_COUNTS = f"{SCORED}, k AS (SELECT count(*) AS n, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p < 0.5 AND y = 0) AS tn, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn FROM scored)"


@query(f"WITH {_COUNTS} SELECT * FROM k")
def confusion(spark, sf_dir):
    return metrics.confusion(b.scored(spark, sf_dir))


_RATES = f"{R6('coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)')} AS accuracy, {R6('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {R6('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall, {R6('coalesce(tn / nullif(tn + fp, 0), 0)')} AS specificity, {R6('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1"


@query(f"WITH {_COUNTS} SELECT n, tp, tn, fp, fn, {_RATES} FROM k")
def prf(spark, sf_dir):
    return metrics.rates(metrics.confusion(b.scored(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT generator, {R6('avg(pow(p - y, 2))')} AS brier FROM scored GROUP BY generator")
def brier(spark, sf_dir):
    return metrics.brier(b.scored(spark, sf_dir), by=["generator"])


def _bins(n: int) -> str:
    return "1 + " + " + ".join(f"(p > {i}e0 / {n})::INT" for i in range(1, n))


def _ece(n: int) -> str:
    return f"WITH {SCORED}, g AS (SELECT {_bins(n)} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1) SELECT {n} AS bins, {R6('sum(n * abs(my - mp)) / sum(n)')} AS ece FROM g"


@query(_ece(15))
def ece15(spark, sf_dir):
    return metrics.calibration_error(b.scored(spark, sf_dir), 15)


@query(_ece(10))
def ece10(spark, sf_dir):
    return metrics.calibration_error(b.scored(spark, sf_dir), 10)


@query(f"WITH {SCORED} SELECT {_bins(10)} AS bin, count(*) AS n, {R6('avg(p)')} AS mean_p, {R6('avg(y)')} AS mean_y FROM scored GROUP BY 1")
def reliability10(spark, sf_dir):
    return metrics.reliability(b.scored(spark, sf_dir), 10)


_W = lambda s: f"((k / n + 1.96e0 * 1.96e0 / (2 * n)) / (1 + 1.96e0 * 1.96e0 / n) {s} 1.96e0 / (1 + 1.96e0 * 1.96e0 / n) * sqrt(k / n * (1 - k / n) / n + 1.96e0 * 1.96e0 / (4 * n * n)))"


@query(f"WITH {SCORED}, g AS (SELECT generator, count(*)::DOUBLE AS n, count(*) FILTER (p >= 0.5 AND y = 1 OR p < 0.5 AND y = 0)::DOUBLE AS k FROM scored GROUP BY generator UNION ALL SELECT 'none', 0, 0) SELECT generator, k, n, {R6(f'CASE WHEN n = 0 THEN 0 ELSE greatest(0, {_W("-")}) END')} AS low, {R6(f'CASE WHEN n = 0 THEN 0 ELSE least(1, {_W("+")}) END')} AS high FROM g")
def wilson_ci(spark, sf_dir):
    counts = metrics.confusion(b.scored(spark, sf_dir), by=["generator"]).select("generator", (F.col("tp") + F.col("tn")).cast("double").alias("k"), F.col("n").cast("double").alias("n"))
    counts = counts.unionByName(spark.createDataFrame([("none", 0.0, 0.0)], "generator string, k double, n double"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return counts.withColumns({"low": low, "high": high})


@query(f"WITH {SCORED}, k AS (SELECT threshold, count(*) AS n, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p < threshold AND y = 0) AS tn, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn FROM scored, (SELECT unnest([0.3e0, 0.4e0, 0.5e0, 0.55e0, 0.6e0, 0.7e0]) AS threshold) GROUP BY threshold) SELECT threshold, n, tp, tn, fp, fn, {_RATES} FROM k")
def threshold_sweep(spark, sf_dir):
    out = metrics.threshold_sweep(b.scored(spark, sf_dir), [0.3, 0.4, 0.5, 0.55, 0.6, 0.7])
    return out


@query(f"WITH {SCORED} SELECT y, least(floor(p * 40), 39)::INT AS bin, count(*) AS n FROM scored GROUP BY 1, 2")
def score_hist40(spark, sf_dir):
    return metrics.histogram(b.scored(spark, sf_dir))


@query(f"WITH {SCORED}, m AS (SELECT doc_id, p, abs(p - 0.45e0) / greatest(CASE WHEN p >= 0.45 THEN 1 - 0.45e0 ELSE 0.45e0 END, 1e-9) AS margin FROM scored) SELECT doc_id, CASE WHEN p >= 0.45 THEN 'AI' ELSE 'real' END AS verdict, CASE WHEN margin > 0.6 THEN 'strong' WHEN margin > 0.25 THEN 'moderate' ELSE 'weak' END AS strength FROM m")
def separation_strength(spark, sf_dir):
    return b.scored(spark, sf_dir).select("doc_id", metrics.verdict(F.col("p"), 0.45).alias("verdict"), metrics.strength(F.col("p"), 0.45).alias("strength"))


@query(f"WITH {SCORED} SELECT generator, count(*) AS n, count(*) FILTER (p >= 0.5) AS flagged, {R6('count(*) FILTER (p >= 0.5) / count(*)')} AS share, {R6('avg(p)')} AS mean, {R6('median(p)')} AS median, {R6('min(p)')} AS low, {R6('max(p)')} AS high FROM scored GROUP BY generator")
def score_summary(spark, sf_dir):
    return metrics.score_summary(b.scored(spark, sf_dir), by=["generator"])


@query(f"WITH {SCORED}, g AS (SELECT group_key, y, count(*) AS n FROM scored GROUP BY 1, 2) SELECT group_key, y, n, {R6('100e0 * n / sum(n) OVER (PARTITION BY y)')} AS percent FROM g")
def class_percent(spark, sf_dir):
    counts = b.scored(spark, sf_dir).groupBy("group_key", "y").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", compare.class_percent("n", ["y"]))


@query(f"WITH {SCORED} SELECT count(*) AS n, {R6('avg((p < 0.5)::INT)')} AS real_accuracy, avg((p < 0.5)::INT) >= 0.9 AS ok FROM scored WHERE y = 0")
def in_domain_gate(spark, sf_dir):
    return audit.in_domain_gate(b.scored(spark, sf_dir))


@query(f"WITH {SCORED}, t AS (SELECT y, count(*) AS n FROM scored GROUP BY y) SELECT max(n) AS larger, min(n) AS smaller, {R6('max(n) / min(n)')} AS ratio FROM t")
def class_balance(spark, sf_dir):
    return compare.class_balance(b.scored(spark, sf_dir), "y")


# ---------------------------------------------------------------- names and sets

_KEY = "regexp_replace(stem, '_(qhi|qlo|rweb|soft|q85|q60|r75q85)$', '', 'i')"
_AUG = "regexp_matches(stem, '_(qhi|qlo|rweb|soft|q85|q60|r75q85)$', 'i')"


@query(f"WITH {FILES} SELECT doc_id, {_KEY} AS group_key FROM files")
def group_key(spark, sf_dir):
    return b.file_records(spark, sf_dir).select("doc_id", names.group_key(F.col("stem")).alias("group_key"))


@query(f"WITH {FILES} SELECT doc_id, {_AUG} AS augmented FROM files")
def is_augmented(spark, sf_dir):
    return b.file_records(spark, sf_dir).select("doc_id", names.is_augmented(F.col("stem")).alias("augmented"))


@query(f"WITH {FILES} SELECT doc_id, CASE WHEN label = 1 THEN coalesce(lower(nullif(split_part(stem, '_', 2), '')), 'unknown') ELSE 'real' END AS generator FROM files")
def generator_tag(spark, sf_dir):
    return b.file_records(spark, sf_dir).select("doc_id", names.generator(F.col("stem"), F.col("label")).alias("generator"))


@query("WITH s AS (SELECT DISTINCT md5(text) AS k FROM benchmark), t AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE text IS NOT NULL UNION SELECT md5(text) FROM benchmark WHERE item_id % 3 = 0) SELECT count(*) AS test_keys, count(t.k) AS shared, round(count(t.k) / count(*), 6) + 0e0 AS share, count(t.k) = 0 AS clean FROM s LEFT JOIN t ON s.k = t.k")
def contamination(spark, sf_dir):
    digest = F.md5(F.col("text").cast("binary")).alias("k")
    bench = b.table(spark, sf_dir, "benchmark")
    train = b.table(spark, sf_dir, "documents").select(digest).unionByName(bench.where("item_id % 3 = 0").select(digest))
    return names.contamination(train, bench.select(digest), "k")


@query("SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def shared_keys(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    return names.shared_keys(docs.where("lang = 'en'"), docs.where("lang = 'fr'"), "source")


@query(f"WITH {FILES} SELECT lower(stem) AS key, list_sort(list(DISTINCT lower(ext))) AS extensions FROM files GROUP BY 1 HAVING count(DISTINCT lower(ext)) > 1")
def stem_collisions(spark, sf_dir):
    return names.collisions(b.file_records(spark, sf_dir), "stem", "ext")


@query(f"WITH {FILES}, n AS (SELECT doc_id, stem, row_number() OVER (PARTITION BY lower(stem) ORDER BY doc_id) AS k FROM files) SELECT doc_id, CASE WHEN k > 1 THEN stem || '__' || k ELSE stem END AS target FROM n")
def collision_rename(spark, sf_dir):
    return names.renamed(b.file_records(spark, sf_dir), "stem", "doc_id").select("doc_id", "target")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IS NOT NULL)")
def resume_anti_join(spark, sf_dir):
    wanted = b.table(spark, sf_dir, "orders").select("o_orderkey")
    done = b.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return names.unfinished(wanted, done, "o_orderkey")


@query("SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents")
def ordinal_encode(spark, sf_dir):
    return names.ordinal(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "code").select("doc_id", F.col("code").cast("long").alias("code"))


@query("SELECT CASE WHEN n <= 12 THEN g END AS generator FROM (SELECT DISTINCT lang AS g, count(DISTINCT lang) OVER () AS n FROM documents) WHERE n <= 12")
def plausible_generators(spark, sf_dir):
    return names.plausible_generators(b.table(spark, sf_dir, "documents").select(F.col("lang").alias("generator")))


def _magnitude_sql(x: str) -> str:
    strip = lambda t: f"regexp_replace({t}, '\\.?0+$', '')"
    places = " ".join(f"WHEN {3 - p} THEN {strip(f"printf('%.{p}f', r)")}" for p in range(1, 7))
    thousand = f"WHEN 3 THEN printf('%s%d', CASE WHEN r < 0 THEN '-' ELSE '' END, floor(abs(r) / 1000)::BIGINT) || ',' || lpad((abs(r) % 1000)::BIGINT::VARCHAR, 3, '0')"
    return f"""x AS (SELECT doc_id, {x} AS v FROM documents), e AS (SELECT *, printf('%.3e', v) AS t FROM x), p AS (SELECT *, TRY_CAST(t AS DOUBLE) AS r, split_part(t, 'e', 1) AS m, TRY_CAST(split_part(t, 'e', 2) AS INT) AS ex FROM e)
SELECT doc_id, CASE WHEN isnan(v) THEN '-' WHEN v = 0 THEN '0' WHEN abs(v) >= 1e-3 AND abs(v) < 1e5 THEN CASE WHEN ex < 4 THEN CASE ex {thousand} {places} END ELSE {strip('m')} || 'e' || split_part(t, 'e', 2) END ELSE printf('%.2e', v) END AS shown FROM p"""


@query("WITH " + _magnitude_sql("CASE doc_id % 14 WHEN 0 THEN 0e0 WHEN 1 THEN 'NaN'::DOUBLE ELSE (1 - 2 * (doc_id % 3 = 0)::INT) * sqrt(n_chars + 0.37e0) * pow(10e0, doc_id % 14 - 8) END"))
def magnitude_format(spark, sf_dir):
    docs, of = b.table(spark, sf_dir, "documents"), F.col("doc_id") % 14
    x = F.when(F.col("doc_id") % 3 == 0, -1.0).otherwise(1.0) * F.sqrt(F.col("n_chars") + F.lit(0.37)) * F.pow(F.lit(10.0), of - 8)
    x = F.when(of == 0, F.lit(0.0)).when(of == 1, F.lit(float("nan"))).otherwise(x)
    return docs.select("doc_id", names.magnitude(x).alias("shown"))


@query(f"WITH {SCORED}, r AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS n FROM scored) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'file_' || doc_id WHEN y = 1 THEN 'ai_' || n ELSE 'real_' || n END AS path FROM r")
def default_names(spark, sf_dir):
    rows = b.scored(spark, sf_dir).select("doc_id", "y", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("file_"), F.col("doc_id"))).alias("path"))
    return names.default_names(ordered.numbered(rows, "doc_id", "n", within=("y",))).select("doc_id", "path")


# ---------------------------------------------------------------- splits

_U = lambda key, seed: f"(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 12))::BIGINT / 281474976710656e0)"


def _folds(name: str, source: str, key: str, label: str, k: int, seed: int = 42) -> str:
    """CTE `name`: the rows of source with fold."""
    return f"""{name}_s AS (SELECT {key} AS g_, count(*) FILTER (WHERE {label} IS DISTINCT FROM 1) AS n0, count(*) FILTER (WHERE {label} = 1) AS n1 FROM {source} GROUP BY {key}),
{name}_p AS (SELECT g_, (row_number() OVER (ORDER BY n1 DESC, CASE WHEN n1 % 2 = 0 THEN n0 ELSE -n0 END, {_U('g_', seed)}, g_) - 1) % {2 * k} AS r FROM {name}_s),
{name}_f AS (SELECT g_, (CASE WHEN r < {k} THEN r ELSE {2 * k - 1} - r END)::INT AS fold FROM {name}_p), {name} AS (SELECT s.*, f.fold FROM {source} s JOIN {name}_f f ON s.{key} IS NOT DISTINCT FROM f.g_)"""


_ORDERS = "o AS (SELECT o_orderkey, o_custkey AS custkey, (o_orderstatus = 'F')::INT AS label FROM orders)"
_SPLIT = f"{_ORDERS}, {_folds('t5', 'o', 'custkey', 'label', 5)}, rest AS (SELECT o_orderkey, custkey, label FROM t5 WHERE fold <> 0), {_folds('c5', 'rest', 'custkey', 'label', 5, 43)}, s AS (SELECT o_orderkey, custkey, label, 'test' AS part FROM t5 WHERE fold = 0 UNION ALL SELECT o_orderkey, custkey, label, CASE WHEN fold = 0 THEN 'cal' ELSE 'train' END FROM c5)"


def _orders(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def _split(spark, sf_dir):
    return splits.split_3way(_orders(spark, sf_dir), "custkey")


@query(f"WITH {_SPLIT} SELECT part, label, count(*) AS n FROM s GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    return splits.describe(_split(spark, sf_dir))


@query(f"WITH {_SPLIT} SELECT count(*) AS groups, count(*) FILTER (n > 1) AS leaking FROM (SELECT custkey, count(DISTINCT part) AS n FROM s GROUP BY 1)")
def split_no_leak(spark, sf_dir):
    return splits.leaks(_split(spark, sf_dir), "custkey")


@query(f"WITH {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_U('o_orderkey', 42)}, o_orderkey) AS k, count(*) OVER (PARTITION BY label) AS n FROM o) SELECT o_orderkey, label, CASE WHEN k <= round(n * 0.2e0) THEN 'test' ELSE 'train' END AS part FROM r")
def split_rows(spark, sf_dir):
    """A random split that keeps the class shares, for rows without groups."""
    return splits.split_rows(_orders(spark, sf_dir), "o_orderkey", "label").select("o_orderkey", "label", "part")


@query(f"WITH {_ORDERS}, g AS (SELECT DISTINCT custkey FROM o), r AS (SELECT custkey, row_number() OVER (ORDER BY {_U('custkey', 42)}, custkey) AS k, count(*) OVER () AS n FROM g) SELECT o_orderkey, k <= greatest(1, round_even(n * 0.1e0, 0)) AS cut FROM o JOIN r USING (custkey)")
def fractional_cut(spark, sf_dir):
    return splits.fractional_cut(_orders(spark, sf_dir), "custkey", 0.1).select("o_orderkey", "cut")


@query("SELECT l_orderkey, l_linenumber, coalesce(l_returnflag IN ('A', 'R'), false) AS by_list, l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS by_table FROM lineitem")
def membership(spark, sf_dir):
    """Which rows' tags are among chosen ones, for a list and for a table of tags."""
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    out = splits.marked(rows, "l_returnflag", ["A", "R"], "by_list").drop("l_returnflag")
    return splits.marked(out, "l_orderkey", b.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey"), "by_table")


@query(f"SELECT doc_id FROM documents ORDER BY {_U('doc_id', 42)}, doc_id LIMIT 200")
def hash_sample(spark, sf_dir):
    return splits.exact_sample(b.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200)


@query(f"WITH {FILES}, x AS (SELECT doc_id, {_AUG} AS aug, {_U('doc_id', 42)} AS u FROM files), k AS (SELECT doc_id, row_number() OVER (ORDER BY u, doc_id) AS r, count(*) OVER () AS n FROM x WHERE aug) SELECT doc_id FROM x WHERE NOT aug UNION ALL SELECT doc_id FROM k WHERE r <= round(n * 0.25e0)")
def thinned_augmented(spark, sf_dir):
    rows = b.file_records(spark, sf_dir).select("doc_id", "stem")
    return splits.thinned(rows, names.is_augmented(F.col("stem")), "doc_id", 0.25).select("doc_id")


@query(f"WITH {_ORDERS}, {_folds('f5', 'o', 'custkey', 'label', 5)} SELECT fold, count(*) AS n, count(DISTINCT custkey) AS groups FROM f5 GROUP BY 1")
def cv_fold_counts(spark, sf_dir):
    rows = splits.balanced_folds(_orders(spark, sf_dir), "custkey", "label", 5)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("custkey").alias("groups"))


@query(f"WITH {_ORDERS}, {_folds('f5', 'o', 'custkey', 'label', 5)} SELECT fold, label, count(*) AS n FROM f5 GROUP BY 1, 2")
def balanced_fold_counts(spark, sf_dir):
    return splits.balanced_folds(_orders(spark, sf_dir), "custkey", "label", 5).groupBy("fold", "label").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, round(40 + {_U('doc_id', 42)} * 30)::INT AS quality FROM documents")
def uniform_quality(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", splits.uniform_int(F.col("doc_id"), 40, 70).alias("quality"))


# ---------------------------------------------------------------- shift and audit


@query(f"WITH {LOGS}, r AS (SELECT variant, count(*) AS n, avg((p >= 0.5)::INT) AS flip, avg(p) AS mean, median(p) AS median FROM variants GROUP BY 1), c AS (SELECT max(flip) AS base FROM r WHERE variant = 'view') SELECT variant, n, {R6('flip')} AS flip_rate, {R6('mean')} AS mean, {R6('median')} AS median, {R6('flip - base')} AS excess, base <= 0.1 AS control_ok FROM r, c")
def flip_table(spark, sf_dir):
    return audit.flip_table(b.variant_scores(spark, sf_dir), control="view")


_SHIFT = f"""{PX}, k AS (SELECT (r * 8 + c)::INT AS col0, avg(CASE WHEN label = 0 THEN v END) AS m0, avg(CASE WHEN label = 1 THEN v END) AS m1, var_pop(CASE WHEN label = 0 THEN v END) AS v0, var_pop(CASE WHEN label = 1 THEN v END) AS v1 FROM px GROUP BY 1),
g AS (SELECT img % 3 AS set, (r * 8 + c)::INT AS col0, avg(v) AS m FROM px GROUP BY 1, 2), f AS (SELECT set, col0, (m - m0) / greatest(sqrt((v0 + v1) / 2), 1e-12) * sign(m1 - m0) AS shift FROM g JOIN k USING (col0))"""


def _shift(spark, sf_dir):
    long = feature_long(spark, sf_dir)
    return audit.signed_shift(long.withColumn("set", F.col("img") % 3), stats.effect_sizes(long, "col0"))


@query(f"WITH {_SHIFT}, r AS (SELECT *, row_number() OVER (PARTITION BY set ORDER BY round(shift, 9) DESC, col0) AS rank FROM f) SELECT set, col0, {R6('shift')} AS shift, rank::INT AS rank FROM r WHERE rank <= 6")
def signed_shift_topk(spark, sf_dir):
    return audit.top_shift(_shift(spark, sf_dir))


@query(f"WITH {_SHIFT} SELECT set, col0 // 8 AS block, {R6('avg(shift)')} AS shift FROM f GROUP BY 1, 2")
def block_shift(spark, sf_dir):
    blocks = spark.range(64).select(F.col("id").cast("int").alias("col0"), F.floor(F.col("id") / 8).cast("int").alias("block"))
    return audit.block_shift(_shift(spark, sf_dir), blocks)


_FACTS = f"""{FILES}, f AS (SELECT *, bytes / (width * height)::DOUBLE AS bpp, CASE WHEN doc_id % 7 < 5 THEN ext ELSE ext || label END AS q, floor({_U('doc_id', 42)} * 3)::INT AS fold FROM files),
ranks AS (SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY bpp) + (count(*) OVER (PARTITION BY fold, bpp) - 1) / 2e0 AS k FROM f),
aucs AS (SELECT fold, (sum(CASE WHEN label = 1 THEN k ELSE 0 END) - sum(label)::DOUBLE * (sum(label) + 1) / 2) / (sum(label)::DOUBLE * sum(1 - label)) AS auc FROM ranks GROUP BY fold),
cue AS (SELECT avg(auc) AS auc, stddev_pop(auc) AS sd FROM aucs),
{", ".join(f"{n} AS (SELECT sum(CASE WHEN n0 = 0 OR n1 = 0 THEN n0 + n1 ELSE 0 END) / (SELECT count(*) FROM f) AS share FROM (SELECT {c} AS v, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM f GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 12))" for n, c in (("es", "ext"), ("qs", "q")))},
{", ".join(f"{n}m AS (SELECT label, median({c}) AS m FROM f GROUP BY label), {n}v AS (SELECT {c} AS x, count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM f GROUP BY 1), {n}t AS (SELECT sum(c0) AS n0, sum(c1) AS n1, max(x) AS last FROM {n}v), {n}a AS (SELECT greatest(n0, n1) / (n0 + n1) AS base, CASE WHEN x < last THEN (sum(c0) OVER (ORDER BY x) + n1 - sum(c1) OVER (ORDER BY x)) / (n0 + n1) END AS acc FROM {n}v, {n}t), {n} AS (SELECT (SELECT max(m) / min(m) FROM {n}m) AS gap, greatest(max(base), max(acc), 1 - min(acc)) AS cut FROM {n}a)" for n, c in (("w", "width"), ("d", "bpp")))},
facts AS (SELECT cue.auc, CASE WHEN sd > 0 THEN (cue.auc - 0.5e0) / sd ELSE 0 END AS sd_from_chance, es.share AS extension_share, qs.share AS table_share, w.gap AS resolution_gap, w.cut AS resolution_cut, d.gap AS density_gap, d.cut AS density_cut FROM cue, es, qs, w, d)"""
#: The rules of the verdict, as SQL over facts.
_RULES = {"cue_uninterpretable": "auc >= 0.8", "cue_shortcut": "auc >= 0.65 AND auc < 0.8", "tables_exclusive": "table_share >= 0.5", "extensions_exclusive": "extension_share >= 0.5", "density": "density_gap >= 1.35", "resolution": "resolution_gap >= 1.25", "width_cut": "resolution_cut >= 0.9 AND resolution_gap < 1.25", "density_cut": "density_cut >= 0.9 AND density_gap < 1.25"}
_RULED = f"""ruled AS (SELECT *, {", ".join(f"{v} AS is_{k}" for k, v in _RULES.items())} FROM facts), counted AS (SELECT *, {" + ".join(f"is_{k}::INT" for k in _RULES)} AS problems FROM ruled)"""
_FACT_COLS = ("auc", "sd_from_chance", "extension_share", "table_share", "resolution_gap", "resolution_cut", "density_gap", "density_cut")
_VERDICT = f"""SELECT {", ".join(f"{R6(c)} AS {c}" for c in _FACT_COLS)}, {", ".join(f"is_{k}" for k in _RULES)}, problems, CASE WHEN problems > 0 THEN 'problems' WHEN sd_from_chance >= 3 THEN 'residual' ELSE 'clean' END AS verdict FROM counted"""


@query(f"WITH {_FACTS}, {_RULED} {_VERDICT}")
def audit_verdict_rules(spark, sf_dir):
    """The audit's facts and verdict over all files; the cue is the density alone, so that SQL can tell its AUC."""
    files = b.file_records(spark, sf_dir).withColumns({"bpp": F.col("bytes") / (F.col("width") * F.col("height")), "qhash": F.when(F.col("doc_id") % 7 < 5, F.col("ext")).otherwise(F.concat("ext", F.col("label").cast("string"))), "fold": splits.fold_of(F.col("doc_id"), 3)})
    of = lambda k: metrics.roc_auc(files.where(F.col("fold") == k), "bpp", "label").select(F.lit(k).alias("fold"), "auc", F.lit(None).cast("double").alias("accuracy"))
    return audit.verdict(audit.container_facts(files, of(0).unionByName(of(1)).unionByName(of(2))))


_CASES = [(0.5, 1.0, 0.2, 0.2, 1.0, 0.6, 1.0, 0.6), (0.5, 3.0, 0.2, 0.2, 1.0, 0.6, 1.0, 0.6), (0.65, 0.1, 0.0, 0.0, 1.0, 0.5, 1.0, 0.5), (0.7999, 9.0, 0.5, 0.0, 1.0, 0.5, 1.0, 0.5), (0.8, 0.0, 0.0, 0.5, 1.0, 0.5, 1.0, 0.5), (0.6, 0.0, 0.49, 0.49, 1.25, 0.95, 1.35, 0.95), (0.6, 0.0, 0.0, 0.0, 1.2, 0.9, 1.24, 0.9), (0.6, 0.0, 0.0, 0.0, 1.3, 0.9, 1.3, 0.9)]


@query(f"WITH facts AS (SELECT {', '.join(f'c{i}::DOUBLE AS {c}' for i, c in enumerate(_FACT_COLS))} FROM (VALUES {', '.join(map(str, _CASES))}) t({', '.join(f'c{i}' for i in range(8))})), {_RULED} {_VERDICT}")
def verdict_rules(spark, sf_dir):
    """The rules at and beside their limits."""
    return audit.verdict(spark.createDataFrame(_CASES, ", ".join(f"{c} double" for c in _FACT_COLS)))


#: Facts at, beside and far from the rules' limits, from a part's key and size; the same expressions in both dialects.
_PART_FACTS = {"auc": "0.5e0 + (p_partkey % 40) / 100e0", "sd_from_chance": "(p_size % 9) / 2e0", "extension_share": "(p_partkey % 11) / 10e0 - 0.5e0", "table_share": "(p_size % 7) / 10e0",
               "resolution_gap": "1e0 + (p_partkey % 12) / 20e0", "resolution_cut": "0.5e0 + (p_size % 6) / 10e0", "density_gap": "1e0 + (p_size % 11) / 20e0", "density_cut": "0.5e0 + (p_partkey % 6) / 10e0"}


@query(f"WITH facts AS (SELECT {', '.join(f'({e})::DOUBLE AS {c}' for c, e in _PART_FACTS.items())} FROM part), {_RULED} SELECT CASE WHEN problems > 0 THEN 'problems' WHEN sd_from_chance >= 3 THEN 'residual' ELSE 'clean' END AS verdict, problems, {', '.join(f'count(*) FILTER (is_{k}) AS {k}' for k in _RULES)}, count(*) AS n FROM counted GROUP BY 1, 2")
def verdicts_of_parts(spark, sf_dir):
    """The rules over facts made from each part, counted by verdict."""
    facts = b.table(spark, sf_dir, "part").select(*(F.expr(e).cast("double").alias(c) for c, e in _PART_FACTS.items()))
    return audit.verdict(facts).groupBy("verdict", "problems").agg(*(F.count_if(f"is_{k}").alias(k) for k in _RULES), F.count("*").alias("n"))


_OUTCOMES = f"""{FILES}, n AS (SELECT *, 'dir' || doc_id || '/' || stem || '.' || ext AS path FROM files), r AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY path) AS k FROM n), t AS (SELECT *, CASE WHEN k > 1 THEN stem || '__' || k ELSE stem END AS target FROM r),
o AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN {_AUG} THEN 'skipped_augmented' WHEN least(width, height) < 448 THEN 'skipped_small' WHEN target IN (SELECT stem FROM files WHERE label = 1) THEN 'existed' ELSE 'written' END AS outcome FROM t)"""


def _outcomes(spark, sf_dir):
    files = b.file_records(spark, sf_dir)
    rows = files.select("doc_id", F.concat(F.lit("dir"), F.col("doc_id").cast("string"), F.lit("/"), "stem", F.lit("."), "ext").alias("path"), "label", "width", "height", F.when(F.col("doc_id") % 11 == 0, "unreadable").alias("error"))
    return folders.outcomes(rows, files.where("label = 1").select(F.col("stem").alias("target")))


_KINDS = ("written", "existed", "skipped_small", "skipped_augmented", "failed")


@query(f"WITH {_OUTCOMES} SELECT label, {', '.join(f"count(*) FILTER (outcome = '{k}') AS {k}" for k in _KINDS)} FROM o GROUP BY ROLLUP (label)")
def run_counters(spark, sf_dir):
    """Outcomes of normalising a folder: from names and sizes alone, no pixel is touched."""
    return images.run_counters(_outcomes(spark, sf_dir))


@query(f"WITH {_OUTCOMES} SELECT count(*) AS n, min(least(width, height)) AS min_short, {R6('median(least(width, height))')} AS median_short, max(least(width, height)) AS max_short FROM o WHERE outcome = 'skipped_small'")
def dropped_sizes(spark, sf_dir):
    return folders.dropped_sizes(_outcomes(spark, sf_dir))


@query(f"WITH {FILES} SELECT doc_id, CASE WHEN least(width, height) < 448 THEN 'TOOSMALL' ELSE 'DONE' END AS status, CASE WHEN least(width, height) >= 448 THEN {R6('bytes / (width * height)::DOUBLE')} END AS bpp FROM files")
def size_floor_status(spark, sf_dir):
    rows = b.file_records(spark, sf_dir).withColumn("bpp", F.col("bytes") / (F.col("width") * F.col("height")))
    return images.answered(rows, ["bpp"]).select("doc_id", "status", "bpp")


@query("SELECT sha256(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_digest_dedup(spark, sf_dir):
    """One file of each content: its digest, and how many there were."""
    files = b.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    digest = F.sha2("content", 256).alias("digest")
    return images.digested(files).select("digest").join(files.groupBy(digest).agg(F.count("*").alias("copies")), "digest")


@query("SELECT sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM benchmark")
def line_count(spark, sf_dir):
    """Lines of a text file, written from the benchmark's passages where executors can all see it."""
    path = b.scratch(spark, "lines")
    b.table(spark, sf_dir, "benchmark").select("text").write.text(path)
    return spark.range(1).select(F.lit(tables.line_count(spark, path)).cast("long").alias("lines"))


@query(f"WITH {LOGS}, r AS (SELECT variant, avg((p >= 0.5)::INT) AS flip FROM variants GROUP BY 1), c AS (SELECT max(flip) <= 1 AS fine FROM r WHERE variant = 'view') SELECT variant, {R6('flip')} AS flip_rate FROM r, c WHERE fine AND variant <> 'view' ORDER BY round(flip, 12) DESC, variant LIMIT 1")
def worst_variant(spark, sf_dir):
    return audit.worst_variant(audit.flip_table(b.variant_scores(spark, sf_dir), control="view", gate=1.0), "view").select("variant", "flip_rate")


@query(f"WITH {LOGS}, r AS (SELECT variant, avg((p >= 0.5)::INT) AS flip FROM variants GROUP BY 1) SELECT variant, {R6('flip')} AS flip_rate, (row_number() OVER (ORDER BY round(flip, 12), variant))::INT AS place FROM r")
def flip_report(spark, sf_dir):
    """Variants in the order of a report: the least flips first."""
    return stats.placed(audit.flip_table(b.variant_scores(spark, sf_dir), control="view"), "flip_rate", "variant").select("variant", "flip_rate", "place")


@query(f"WITH {_SHIFT}, blocks AS (SELECT col0 // 8 AS block, avg(shift) AS shift FROM f WHERE set = 0 GROUP BY 1) SELECT block, {R6('shift')} AS shift, (row_number() OVER (ORDER BY round(shift, 12) DESC, block))::INT AS place FROM blocks")
def block_report(spark, sf_dir):
    """Blocks in the order of a report: the largest shift first."""
    blocks = spark.range(64).select(F.col("id").cast("int").alias("col0"), F.floor(F.col("id") / 8).cast("int").alias("block"))
    return stats.placed(audit.block_shift(_shift(spark, sf_dir).where("set = 0"), blocks), "shift", "block", descending=True).select("block", "shift", "place")


@query(f"WITH {FILES}, p AS (SELECT stem || '_' || doc_id || '.' || ext AS path FROM files) SELECT path FROM p ORDER BY path LIMIT 5")
def first_examples(spark, sf_dir):
    rows = b.file_records(spark, sf_dir).select(F.concat("stem", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), "ext").alias("path"))
    return names.first_examples(rows, "path")


@query("SELECT source FROM documents WHERE lang = 'en' UNION SELECT source FROM documents WHERE lang = 'de'")
def all_values(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents")
    return names.all_values(docs.where("lang = 'en'"), docs.where("lang = 'de'"), "source")


@query("SELECT c AS \"check\", value, least, value >= least AS ok FROM (SELECT 'documents' AS c, count(*) AS value, 200 AS least FROM documents UNION ALL SELECT 'benchmark', count(*), 1000000 FROM benchmark)")
def setup_counts(spark, sf_dir):
    rows = lambda name, least: b.table(spark, sf_dir, name).agg(F.lit(name).alias("check"), F.count("*").alias("value"), F.lit(least).alias("least"))
    return audit.setup(rows("documents", 200).unionByName(rows("benchmark", 1_000_000)))


@query("SELECT k AS key FROM (VALUES ('en'), ('fr'), ('xx')) t(k) WHERE k NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def missing_keys(spark, sf_dir):
    have = b.table(spark, sf_dir, "documents").select(F.col("lang").alias("key"))
    return audit.missing_keys(have, ["en", "fr", "xx"])


@query("SELECT source, count(*) FILTER (contains(text, 'the')) > 0 AS has_the, count(*) FILTER (contains(text, 'zzz')) > 0 AS has_zzz FROM documents GROUP BY source")
def marker_check(spark, sf_dir):
    lines = b.table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("text").alias("value"))
    return audit.markers(lines, ["the", "zzz"]).select(F.col("path").alias("source"), "has_the", "has_zzz")


# ---------------------------------------------------------------- the evaluation sketch

_EDGES = ", ".join(f"({i}, {e!r}::DOUBLE)" for i, e in enumerate(sketch.edges()))
_CELLS = f"e(i, edge) AS (VALUES {_EDGES}), cells AS (SELECT generator, y, coalesce((SELECT max(edge) FROM e WHERE edge <= p), '-infinity'::DOUBLE) AS low, p FROM scored)"


@query(f"WITH {SCORED}, {_CELLS} SELECT generator, y::INT AS y, CASE WHEN isinf(low) THEN -1 ELSE {R6('low')} END AS low, count(*) AS n, {R6('sum(p)')} AS sum_p, {R6('sum((p - y) * (p - y))')} AS sum_gap FROM cells GROUP BY generator, y, cells.low")
def evaluation_sketch(spark, sf_dir):
    """Counts between all bin edges and thresholds, for each set and class."""
    cells = sketch.sketch(b.scored(spark, sf_dir), sketch.edges(), ["generator"])
    return cells.withColumn("low", F.greatest("low", F.lit(-1.0)))


def _bins(n: int) -> str:
    """SQL of the calibration error over n right-closed bins."""
    return f"(SELECT sum(n * abs(my - mp)) / sum(n) FROM (SELECT count(*) AS n, avg(p) AS mp, avg(y::DOUBLE) AS my FROM scored GROUP BY (SELECT count(*) FROM range(1, {n}) t(i) WHERE p > i / {n}e0)))"


@query(f"""WITH {SCORED}, h AS (SELECT least(floor(p * 40), 39) AS bin, count(*) AS n FROM scored WHERE y = 1 GROUP BY 1)
SELECT count(*) AS n, {R6(_bins(10))} AS ece10, {R6(_bins(15))} AS ece15, {R6('avg((p - y) * (p - y))')} AS brier, {R6('avg(((p >= 0.5)::INT = y)::INT::DOUBLE)')} AS accuracy,
count(*) FILTER (p >= 0.7 AND y = 1) AS tp_at_7, (SELECT bin::INT FROM h ORDER BY n DESC, bin LIMIT 1) AS fullest_bin FROM scored""")
def merged_sketch_report(spark, sf_dir):
    """One row of reports from the merged sketches of two halves of the scores."""
    rows = b.scored(spark, sf_dir)
    halves = [b.written(sketch.sketch(rows.where(F.col("doc_id") % 2 == k), sketch.edges()), "sketch") for k in (0, 1)]
    cells = sketch.merged(halves)
    one = sketch.sweep(cells, [0.5, 0.7]).agg(F.max("n").alias("n"), F.max(F.when(F.col("threshold") == 0.5, F.col("accuracy"))).alias("accuracy"), F.max(F.when(F.col("threshold") == 0.7, F.col("tp"))).alias("tp_at_7"))
    errors = [sketch.calibration_error(cells, k).select(F.col("ece").alias(f"ece{k}")) for k in (10, 15)]
    full = sketch.histogram(cells).where("y = 1").agg(F.max(F.struct("n", (-F.col("bin")).alias("bin"))).alias("h")).select((-F.col("h.bin")).cast("int").alias("fullest_bin"))
    for more in (*errors, sketch.brier(cells), full):
        one = one.join(F.broadcast(more))  # one row each
    return one


@query(f"WITH {SCORED} SELECT generator, (1 + (SELECT count(*) FROM range(1, 10) t(i) WHERE p > i / 10e0))::INT AS bin, count(*) AS n, {R6('avg(p)')} AS mean_p, {R6('avg(y::DOUBLE)')} AS mean_y FROM scored GROUP BY generator, 2")
def reliability_rows(spark, sf_dir):
    """A reliability table for each set, by the table function over its sketch, from SQL."""
    functions.register(spark)
    cells = b.written(sketch.sketch(b.scored(spark, sf_dir), sketch.edges(), ["generator"]), "sketch")
    return spark.sql("SELECT * FROM reliability_rows(TABLE({cells}) PARTITION BY (generator), 'generator', 10)", cells=cells)


@query(f"WITH {SCORED}, t(threshold) AS (VALUES (0.4e0), (0.6e0)) SELECT generator, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p < threshold AND y = 0) AS tn, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn, {R6('avg(((p >= threshold)::INT = y)::INT::DOUBLE)')} AS accuracy FROM scored, t GROUP BY 1, 2")
def sweep_rows(spark, sf_dir):
    """Counts at thresholds for each set, by the table function over its sketch, from SQL."""
    functions.register(spark)
    cells = b.written(sketch.sketch(b.scored(spark, sf_dir), sketch.edges(), ["generator"]), "sketch")
    return spark.sql("SELECT * FROM sweep_rows(TABLE({cells}) PARTITION BY (generator), 'generator', array(0.4D, 0.6D))", cells=cells)
