"""Inspect, plan and verify territories from files; requests have ids by which they can be cancelled."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pipewright.plans import planner
from pipewright.session import cut
from pipewright.sources import geojson

REQUEST_ID = re.compile(r"[a-zA-Z0-9-]{8,80}")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: size, counts, first error (see sources.geojson.inspect).

    Files of other names than .geojson and .json, and empty ones, aren't read: WRONG_TYPE, EMPTY_FILE."""
    return geojson.inspect(geojson.read(spark, path)).unionByName(geojson.refusals(spark, path))


def plan(spark: SparkSession, path: str, request_id: str, options: planner.Options | None = None, roads: planner.RoadData | None = None) -> DataFrame:
    """Planned variants of the territories in files, computed here under the request's tag, so that cancel() reaches it."""
    if not REQUEST_ID.fullmatch(request_id):
        raise ValueError("a request id has 8 to 80 letters, digits and hyphens")
    spark.addTag(request_id)
    try:
        found = planner.plan(geojson.planning_features(geojson.features(geojson.read(spark, path))), options, roads)
        return cut(found)
    finally:
        spark.removeTag(request_id)


def cancel(spark: SparkSession, request_id: str) -> bool:
    """Stop the jobs of a request; whether there were any."""
    return bool(spark.interruptTag(request_id))
