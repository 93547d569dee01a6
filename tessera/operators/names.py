"""File names: augmented suffixes, source keys, generator tags, collisions, resumption, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import dense_places

#: Suffixes of augmented copies.
SUFFIXES = ("qhi", "qlo", "rweb", "soft", "q85", "q60", "r75q85")
SUFFIX = f"(?i)_({'|'.join(SUFFIXES)})$"
IMAGES = r"(?i)\.(jpe?g|png)$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def stem_of(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def is_augmented(stem: Column) -> Column:
    return stem.rlike(SUFFIX)


def group_key(stem: Column) -> Column:
    """The stem of the source photo: the augmented suffix goes."""
    return F.regexp_replace(stem, SUFFIX, "")


def generator(stem: Column, label: Column, strip: bool = False) -> Column:
    """The second `_` token of an AI file's stem, lower-cased; `unknown` without one; `real` for the other class."""
    token = F.try_element_at(F.split(group_key(stem) if strip else stem, "_"), F.lit(2))
    return F.when(label == 1, F.coalesce(F.lower(token), F.lit("unknown"))).otherwise("real")


def plausible_generators(rows: DataFrame, tag: str = "generator", most: int = 12) -> DataFrame:
    """The distinct tags, or none if there are more than `most`: then they aren't tags."""
    tags = rows.select(tag).where(F.col(tag) != "real").distinct()
    return tags.join(F.broadcast(tags.agg((F.count("*") <= most).alias("fine"))), F.col("fine")).drop("fine")  # one row


def collisions(files: DataFrame, key: str = "key", ext: str = "ext") -> DataFrame:
    """(key, extensions) of stems that occur with more than one extension, in any case."""
    return files.groupBy(F.lower(key).alias("key")).agg(F.sort_array(F.collect_set(F.lower(ext))).alias("extensions")).where(F.size("extensions") > 1)


def renamed(files: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """files with target: the stem, and `__2`, `__3`, ... for later files with the same stem in any case."""
    n = F.row_number().over(Window.partitionBy(F.lower(stem)).orderBy(path))  # of the files that share a stem
    return files.withColumn("n_", n).withColumn("target", F.when(F.col("n_") > 1, F.concat(stem, F.lit("__"), F.col("n_").cast("string"))).otherwise(F.col(stem))).drop("n_")


def unfinished(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The wanted outputs that don't exist yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def contamination(train: DataFrame, test: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """(test_keys, shared, share, clean): distinct test keys that occur in training."""
    keys = test.select(key).where(F.col(key).isNotNull()).distinct()
    seen = train.select(key).distinct().withColumn("seen", F.lit(1))
    return keys.join(seen, key, "left").agg(F.count("*").alias("test_keys"), F.count("seen").alias("shared")).withColumns({"share": F.try_divide("shared", "test_keys"), "clean": F.col("shared") == 0})


def shared_keys(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return test.select(key).intersect(train.select(key))


def all_values(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct values of either table; a null counts as a value."""
    return a.select(key).union(b.select(key)).distinct()


def first_examples(rows: DataFrame, path: str, k: int = 5) -> DataFrame:
    """The k rows whose paths come first: a top-k, not a sort of all rows."""
    return rows.orderBy(path).limit(k)


def ordinal(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the place of their value among the sorted distinct ones, from 0; nulls are a value of their own, last."""
    codes = dense_places(rows, column, name).withColumn(name, F.col(name).cast("int"))
    return rows.join(codes, F.col(column).eqNullSafe(F.col("value_"))).drop("value_")


def default_names(rows: DataFrame, label: str = "y", number: str = "n", path: str = "path") -> DataFrame:
    """rows with path filled where it is null: real_1, real_2, ... and ai_1, ai_2, ..., from their number within the class."""
    made = F.concat(F.when(F.col(label) == 1, "ai_").otherwise("real_"), F.col(number).cast("string"))
    return rows.withColumn(path, F.coalesce(path, made))


def magnitude(x: Column, digits: int = 4) -> Column:
    """A number as text at any size: `-` for NaN, 0, `digits` significant digits and thousands marked from 1e-3 to below 1e5, two places and an exponent outside.

    A number that needs more places before the point than `digits` has an exponent too. Trailing zeros go.
    """
    text = F.format_string(f"%.{digits - 1}e", x)
    rounded, exponent = text.cast("double"), F.substring_index(text, "e", -1).cast("int")
    zeros = lambda c: F.regexp_replace(c, r"\.?0+$", "")
    plain = F.format_number(rounded, 0)
    for places in range(1, digits + 3):
        plain = F.when(digits - 1 - exponent == places, zeros(F.format_number(rounded, places))).otherwise(plain)
    short = F.concat(zeros(F.substring_index(text, "e", 1)), F.lit("e"), F.substring_index(text, "e", -1))
    inside = F.when(exponent < digits, plain).otherwise(short)
    return F.when(F.isnan(x), "-").when(x == 0, "0").when((F.abs(x) >= 1e-3) & (F.abs(x) < 1e5), inside).otherwise(F.format_string("%.2e", x))
