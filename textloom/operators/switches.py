"""Settings in layers, as tables: which checks are on for which format of which project.

A user's settings hold for all their projects, a project's for its formats; each layer gives the switches that it names and leaves the
rest. An override of a single format stands alone: what it doesn't name is on, whatever the layers below say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .validate import CHECKS


def resolved(formats: DataFrame, users: DataFrame, projects: DataFrame, overrides: DataFrame) -> DataFrame:
    """user, project, format and a switch for each check, for (user, project, format).

    ``users`` (user, checks), ``projects`` (project, checks) and ``overrides`` (project, format, checks): each of the checks null where a layer says nothing.
    If a layer has more than one row for its key, a check is off if one of them switches it off. Three joins by key; layers are small beside the formats or
    come with them.
    """

    def layer(rows: DataFrame, name: str, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.struct(*[F.bool_and(c).alias(c) for c in CHECKS]).alias(name))

    out = formats.join(layer(users, "_user", "user"), "user", "left").join(layer(projects, "_project", "project"), "project", "left")
    out = out.join(layer(overrides, "_override", "project", "format"), ["project", "format"], "left")
    on = lambda c: F.when(F.col("_override").isNotNull(), F.coalesce(F.col(f"_override.{c}"), F.lit(True))).otherwise(F.coalesce(F.col(f"_project.{c}"), F.col(f"_user.{c}"), F.lit(True)))
    return out.select("user", "project", "format", *[on(c).alias(c) for c in CHECKS])
