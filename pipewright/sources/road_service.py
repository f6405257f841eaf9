"""A map service for roads as a data source: one request for each tile of a box, filters pushed down, a second endpoint after a failure.

    read_roads(spark, ["https://one", "https://two"], (37.5, 55.6, 37.6, 55.7)).where("highway = 'primary'")

An endpoint is an address that takes a query, or a folder (one that all executors see) with a saved
response for each tile. What is asked for is narrowed by conditions on ``highway`` (classes) and on the
ways' extents (``east >= 37.52`` and the like), before any request is made.
"""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from pipewright.sources.roads import HIGHWAYS

#: km2 that may be asked for at once, seconds for the server and for a response, km to a degree of latitude.
MOST_AREA, SERVER_SECONDS, SECONDS, KM = 100.0, 25, 35, 111.32
SCHEMA = "id bigint, highway string, tags map<string,string>, geometry array<struct<lon:double,lat:double>>, west double, south double, east double, north double"


def area_km2(box: tuple[float, float, float, float]) -> float:
    west, south, east, north = box
    return (east - west) * (north - south) * KM**2 * math.cos(math.radians((south + north) / 2))


@dataclass
class Tile(InputPartition):
    """A tile of the box, by its numbers in the grid of all tiles."""

    x: int
    y: int
    box: tuple[float, float, float, float]

    def name(self) -> str:
        return "_".join(f"{v:.6f}" for v in self.box) + ".json"


class RoadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoints = [e.strip() for e in options["endpoints"].split(",") if e.strip()]
        self.box = tuple(float(v) for v in options["box"].split(","))
        self.tile = float(options.get("tile", 0.02))
        self.classes = set(HIGHWAYS)
        if not self.endpoints or len(self.box) != 4 or not all(map(math.isfinite, self.box)) or self.tile <= 0:
            raise ValueError("endpoints, a box of four numbers (west, south, east, north) and a positive tile are needed")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Classes are left to the service; extents narrow the box, and stay with Spark as well."""
        west, south, east, north = self.box
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "highway" and isinstance(f, (EqualTo, In)):
                self.classes &= {f.value} if isinstance(f, EqualTo) else set(f.value)
                continue
            least, most = isinstance(f, (GreaterThan, GreaterThanOrEqual)), isinstance(f, (LessThan, LessThanOrEqual))
            if column == "east" and least:
                west = max(west, f.value)
            elif column == "west" and most:
                east = min(east, f.value)
            elif column == "north" and least:
                south = max(south, f.value)
            elif column == "south" and most:
                north = min(north, f.value)
            yield f
        self.box = (west, south, east, north)

    def partitions(self) -> list[Tile]:
        west, south, east, north = self.box
        if not self.classes or west > east or south > north:
            return []
        if west == east or south == north:
            raise ValueError("the box has no area")
        if east - west > 180 or area_km2(self.box) > MOST_AREA:
            raise ValueError(f"the box has more than {MOST_AREA:g} km2")
        first = [math.floor(v / self.tile + 1e-9) for v in (west, south)]
        last = [math.ceil(v / self.tile - 1e-9) - 1 for v in (east, north)]
        corner = lambda x, y: (round(x * self.tile, 9), round(y * self.tile, 9), round((x + 1) * self.tile, 9), round((y + 1) * self.tile, 9))
        return [Tile(x, y, corner(x, y)) for y in range(first[1], last[1] + 1) for x in range(first[0], last[0] + 1)]

    def fetched(self, tile: Tile) -> list[dict]:
        """Elements of a tile's response, of the first endpoint that gives a whole one."""
        failures = []
        for endpoint in self.endpoints:
            try:
                if endpoint.startswith(("http://", "https://")):
                    west, south, east, north = tile.box
                    query = f'[out:json][timeout:{SERVER_SECONDS}];way["highway"~"^({"|".join(sorted(self.classes))})$"]({south},{west},{north},{east});out geom;'
                    with urllib.request.urlopen(endpoint, urllib.parse.urlencode({"data": query}).encode(), timeout=SECONDS) as response:  # noqa: S310
                        found = json.load(response)
                else:
                    with open(f"{endpoint}/{tile.name()}", encoding="utf-8") as f:
                        found = json.load(f)
                if found.get("remark"):
                    raise ValueError(f"incomplete response: {found['remark']}")
                return found["elements"]
            except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
                failures.append(f"{endpoint}: {e}")
        raise RuntimeError(f"no endpoint gave the tile {tile.name()}: {'; '.join(failures)}")

    def read(self, tile: Tile) -> Iterator[tuple]:
        asked = {(t.x, t.y) for t in self.partitions()}
        for e in self.fetched(tile):
            tags, line = e.get("tags") or {}, [(p["lon"], p["lat"]) for p in e.get("geometry") or [] if p]
            if e.get("type") != "way" or tags.get("highway") not in self.classes or not line:
                continue
            xs, ys = [p[0] for p in line], [p[1] for p in line]
            west, south, east, north = min(xs), min(ys), max(xs), max(ys)
            cell = lambda v: math.floor(v / self.tile + 1e-9)
            # a way comes with every tile that it touches, and is given by the first of those that are asked for
            touched = ((y, x) for y in range(cell(south), cell(north) + 1) for x in range(cell(west), cell(east) + 1) if (x, y) in asked)
            home = min(touched, default=(tile.y, tile.x))  # none: it only touches the edge of the last tile
            if home == (tile.y, tile.x):
                yield e["id"], tags["highway"], tags, line, west, south, east, north


class RoadService(DataSource):
    """Ways of the classes that carry vehicles in a box; options: endpoints, box, tile (degrees)."""

    @classmethod
    def name(cls) -> str:
        return "road_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RoadReader:
        return RoadReader(dict(self.options))


def read_roads(spark: SparkSession, endpoints: list[str], box: tuple[float, float, float, float], tile: float = 0.02) -> DataFrame:
    """Ways of a box (west, south, east, north) from the first of the endpoints that answers; lets filters reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RoadService)
    options = {"endpoints": ",".join(endpoints), "box": ",".join(map(repr, box)), "tile": repr(tile)}
    return spark.read.format("road_service").options(**options).load()
