"""Model listings of providers as tables: prices by model, and whether a model is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PRICED = "data array<struct<id:string,pricing:struct<prompt:string,completion:string>>>"
_INSTALLED = "models array<struct<name:string>>"


def prices(listing: DataFrame) -> DataFrame:
    """model, price_in, price_out (per 1000 tokens) of listings (body: JSON). A price that is missing or no number is 0."""
    rows = listing.select(F.explode(F.from_json("body", _PRICED)["data"]).alias("m"))
    price = lambda c: F.coalesce(F.col(f"m.pricing.{c}").try_cast("double") * 1000, F.lit(0.0))
    return rows.select(F.col("m.id").alias("model"), price("prompt").alias("price_in"), price("completion").alias("price_out"))


def priced(models: DataFrame, listing: DataFrame) -> DataFrame:
    """Models (model) with their prices; 0 for those that the listing lacks."""
    return models.join(prices(listing).dropDuplicates(["model"]), "model", "left").na.fill(0.0, ["price_in", "price_out"])


def installed(models: DataFrame, listing: DataFrame) -> DataFrame:
    """Models (model) with ``found``: a listing (body: JSON) names them, exactly or with the tag ``latest``."""
    names = listing.select(F.explode(F.from_json("body", _INSTALLED)["models"]["name"]).alias("name"))
    names = names.select(F.explode(F.array("name", F.regexp_replace("name", r":latest\z", ""))).alias("model")).distinct()
    return models.join(names.withColumn("found", F.lit(True)), "model", "left").na.fill(False, ["found"])
