"""The pipe catalogue and the price rules that hang on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Diameter mm, capacity t/h, longest run m, price per m, width of the pair m.
PIPES = [
    (50, 3.5, 181.0, 74023.0, 0.40),
    (65, 8.3, 245.0, 78631.0, 0.43),
    (80, 13.2, 327.0, 83530.0, 0.47),
    (100, 22.3, 419.0, 89748.0, 0.51),
    (125, 40.2, 554.0, 97275.0, 0.60),
    (150, 65.1, 696.0, 105507.0, 0.65),
    (200, 152.3, 1042.0, 120275.0, 0.88),
    (250, 274.9, 1379.0, 135323.0, 1.05),
    (300, 437.4, 1718.0, 150022.0, 1.15),
    (400, 943.1, 2477.0, 190299.0, 1.37),
    (500, 1663.4, 3245.0, 224137.0, 1.67),
    (600, 2627.7, 4037.0, 264790.0, 1.85),
    (700, 3735.1, 4775.0, 324298.0, 2.05),
    (800, 5296.8, 5644.0, 325996.0, 2.25),
    (900, 7165.0, 6518.0, 327693.0, 2.45),
    (1000, 9391.8, 7419.0, 418777.0, 2.65),
    (1200, 15012.8, 9288.0, 428074.0, 3.10),
    (1400, 22501.9, 11276.0, 683417.0, 3.45),
]
#: Price of a chamber up to a diameter (mm).
CHAMBER_TIERS = [(200, 3_000_000.0), (500, 5_000_000.0), (1000, 8_000_000.0), (1400, 12_000_000.0)]
#: Joining at an existing chamber; penalty of a consumer left out, and per t/h of its flow.
TIE_IN_PRICE, PENDING_BASE, PENDING_PER_FLOW = 5_000_000.0, 100_000_000.0, 500_000.0
#: Weights and units of the score.
COST_SHARE, COST_UNIT, LENGTH_SHARE, LENGTH_UNIT = 0.7, 25_000_000.0, 0.3, 100.0
#: Price factor of laying a pipe across something, and the factor for everything else.
TARIFF = {"road": 1.60, "tram_tracks": 1.75, "gas_pipeline": 1.25, "power_cable": 1.15}
TARIFF_OTHER = 1.05


def chamber_price(dn_mm: int) -> float:
    return next(price for most, price in CHAMBER_TIERS if dn_mm <= most)


def catalog(spark: SparkSession) -> DataFrame:
    """dn_idx, dn, capacity, max_length, price, width, chamber: 18 rows."""
    rows = [(i, *p, chamber_price(p[0])) for i, p in enumerate(PIPES)]
    return spark.createDataFrame(rows, "dn_idx int, dn int, capacity double, max_length double, price double, width double, chamber double")


def _pick(index: Column, values: list[float]) -> Column:
    """Value of a 0-based index in a literal list; null outside."""
    inside = (index >= 0) & (index < len(values))
    return F.when(inside, F.element_at(F.array(*map(F.lit, values)), F.when(inside, index + 1).otherwise(1)))


def price(dn_idx: Column) -> Column:
    return _pick(dn_idx, [p[3] for p in PIPES])


def width(dn_idx: Column) -> Column:
    return _pick(dn_idx, [p[4] for p in PIPES])


def max_length(dn_idx: Column) -> Column:
    return _pick(dn_idx, [p[2] for p in PIPES])


def chamber(dn_idx: Column) -> Column:
    return _pick(dn_idx, [chamber_price(p[0]) for p in PIPES])


def diameter(dn_idx: Column) -> Column:
    return _pick(dn_idx, [p[0] for p in PIPES]).cast("int")


def smallest(flow: Column, length: Column) -> Column:
    """Index of the smallest pipe that carries the flow over the length; -1 if none does."""
    fits = [F.when((F.lit(p[1]) >= flow) & (F.lit(p[2]) >= length), F.lit(i)) for i, p in enumerate(PIPES)]
    return F.coalesce(*fits, F.lit(-1))


def index_of(dn_mm: Column) -> Column:
    """Catalogue index of a diameter in mm; null if it isn't in the catalogue."""
    return F.coalesce(*[F.when(dn_mm == p[0], F.lit(i)) for i, p in enumerate(PIPES)])


def tariff(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TARIFF.items()], F.lit(TARIFF_OTHER))


def clearance(kind: Column, dn_mm: Column, existing_width: Column | None = None) -> Column:
    """Least distance in m from the outside of a new pipe of dn_mm to an obstacle of a kind."""
    building = F.when(dn_mm < 500, 5.0).when(dn_mm < 900, 7.0).otherwise(9.0)
    line = F.lit(1.0) + (existing_width / 2 if existing_width is not None else F.lit(0.0))
    return (
        F.when(kind == "oks", building).when(kind.isin("road", "tram_tracks"), 1.5).when(kind == "gas_pipeline", 2.20)
        .when(kind == "power_cable", 2.10).when(kind == "heat_network", line).otherwise(1.0)
    )


def score(cost: Column, length: Column) -> Column:
    return F.lit(COST_SHARE) * cost / F.lit(COST_UNIT) + F.lit(LENGTH_SHARE) * length / F.lit(LENGTH_UNIT)


def pending_penalty(flow: Column) -> Column:
    return F.lit(PENDING_BASE) + F.lit(PENDING_PER_FLOW) * flow
