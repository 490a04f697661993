"""Primary, gallery and all images of an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.heuristics import best_image, image_score


def _urls(df: DataFrame, name: str) -> Column:
    """A string or list column as a list of non-empty strings; an absent one is an empty list."""
    empty = F.array().cast("array<string>")
    kind = dict(df.dtypes).get(name)
    if kind == "string":
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.array(F.col(name))).otherwise(empty)
    if kind == "array<string>":
        return F.coalesce(F.filter(F.col(name), lambda v: F.coalesce(v, F.lit("")) != ""), empty)
    return empty


def _gallery(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    found = [F.when(F.col(n).isNotNull(), _urls(df, n)) for n in ("gallery_images", "images") if kinds.get(n) == "array<string>"]
    return F.coalesce(*found, F.array().cast("array<string>"))


def primary(df: DataFrame) -> Column:
    """The best image of the list item if it isn't decoration, else the gallery's first that isn't, else its first, else that best one."""
    best, gallery = best_image(_urls(df, "image")), _gallery(df)
    good = F.filter(gallery, lambda u: image_score(u) >= -50)
    return F.when(image_score(best) >= -50, best).otherwise(F.coalesce(F.get(good, F.lit(0)), F.get(gallery, F.lit(0)), best))


def shape(df: DataFrame, want_primary: bool, want_gallery: bool, want_all: bool) -> DataFrame:
    """Image columns as the flags ask: ``images`` becomes ``gallery_images``, ``primary_image`` and ``all_images`` are made or dropped."""
    kinds = dict(df.dtypes)
    if (want_gallery or want_all) and "images" in df.columns:
        if kinds["images"] == "array<string>":
            old = F.col("gallery_images") if "gallery_images" in df.columns else F.lit(None).cast("array<string>")
            df = df.withColumn("gallery_images", F.coalesce(old, F.col("images")))
        df = df.drop("images")
    if want_primary or want_all:
        was = F.col("primary_image") if "primary_image" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("primary_image", F.coalesce(primary(df), was))
    else:
        df = df.drop("primary_image")
    if not want_all:
        return df.drop("all_images")
    every = F.array_distinct(F.concat(_urls(df, "image"), _urls(df, "primary_image"), _gallery(df)))
    return df.withColumn("all_images", F.when(F.size(every) > 0, every))
