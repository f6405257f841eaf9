"""Top-k within groups, skylines and greedy choice of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipewright.session import cut


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles them."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)


def skyline(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Rows that no other row of their group matches or beats in both columns (one of equal rows stays)."""
    best = df.groupBy(*keys, first).agg(F.min(second).alias(second))
    before = Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_least", F.min(second).over(before)).where(F.col("_least").isNull() | (F.col(second) < F.col("_least"))).drop("_least")


def beam(candidates: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Of candidates(connected, weight, signature): without copies, most connected first, then by weight; ``width`` of each group."""
    distinct = candidates.dropDuplicates([*keys, "signature"])
    return top_k(distinct, keys, [F.col("connected").desc(), "weight", "signature"], width)


def select_variants(candidates: DataFrame, keys: list[str], most: int = 3, worse: float = 0.35) -> DataFrame:
    """Of each group the candidates with the highest count of connected consumers whose score is at most
    (1 + worse) times the best of those, best first, ``most`` at the end."""
    group = Window.partitionBy(*keys)
    full = candidates.withColumn("_top", F.max("connected").over(group)).where("connected = _top")
    near = full.withColumn("_best", F.min("score").over(group)).where(F.col("score") <= F.col("_best") * (1 + worse))
    return top_k(near.drop("_top", "_best"), keys, ["score", "signature"], most)


def accept_offers(offers: DataFrame, taker: str, giver: str, turn: str, capacity: int, rounds: int) -> DataFrame:
    """Which offers are taken: rows of offers(taker, giver, turn, ...), at most one for a taker and ``capacity`` for a giver.

    In round r each taker without a place makes its r-th offer (turn = r, from 1), and each giver takes those of the round
    in the takers' order as long as it has places. So nobody gets a second try before everybody had a first one. A
    round's window keeps ``capacity`` rows of a giver before it shuffles, however many offer to it; rows with a null
    taker or giver are never taken, and of a taker's equal offers one is."""
    offers = offers.where(F.col(taker).isNotNull() & F.col(giver).isNotNull()).dropDuplicates([taker, giver, turn])
    taken = offers.limit(0)
    for r in range(1, rounds + 1):
        here = offers.where(F.col(turn) == r).dropDuplicates([taker]).join(taken.select(taker), taker, "left_anti")
        first = top_k(here, [giver], [taker], capacity)
        used = taken.groupBy(giver).agg(F.count(F.lit(1)).alias("_used"))
        fits = first.join(used, giver, "left").where(F.col("rn") <= capacity - F.coalesce("_used", F.lit(0)))
        taken = cut(taken.unionByName(fits.select(*offers.columns)))
    return taken


def select_diverse(candidates: DataFrame, parts: DataFrame, keys: list[str], key: str, most: int = 3, worse: float = 0.35, overlap: float = 0.85) -> DataFrame:
    """Of each group up to ``most`` candidates as in select_variants, but only such as differ from all that were taken before.

    candidates(keys, key, connected, score, signature, kind); parts(keys, key, part, weight): what each runs along, a part
    once. Two differ if their kinds do (numbers of roots, groups of consumers), or if one of them has less than the share
    ``overlap`` of its weight in parts that the other has as well. rn: 1, 2 ... in the order in which they are taken.

    A round takes each group's best candidate and drops what is like it, so ``most`` rounds do, and a candidate meets
    nothing but the one that was taken, by an equi-join on parts; no two candidates of a group are paired otherwise."""
    group = Window.partitionBy(*keys)
    full = candidates.withColumn("_top", F.max("connected").over(group)).where("connected = _top")
    left = cut(full.withColumn("_best", F.min("score").over(group)).where(F.col("score") <= F.col("_best") * (1 + worse)).drop("_top", "_best"))
    owned = cut(parts.join(left.select(*keys, key), [*keys, key], "left_semi"))
    whole = owned.groupBy(*keys, key).agg(F.sum("weight").alias("_all"))
    taken: DataFrame | None = None
    for r in range(1, most + 1):
        best = cut(top_k(left, keys, ["score", "signature"], 1).withColumn("rn", F.lit(r)))
        taken = best if taken is None else taken.unionByName(best)
        if r == most:
            break
        rest = left.join(best.select(*keys, key), [*keys, key], "left_anti")
        theirs = owned.join(best.select(*keys, key), [*keys, key], "left_semi").select(*keys, F.col(key).alias("_taken"), "part", F.col("weight").alias("_weight"))
        met = owned.join(theirs, [*keys, "part"]).groupBy(*keys, key, "_taken").agg(F.sum("weight").alias("_mine"), F.sum("_weight").alias("_theirs"))
        share = met.join(whole, [*keys, key]).join(whole.select(*keys, F.col(key).alias("_taken"), F.col("_all").alias("_all_theirs")), [*keys, "_taken"])
        alike = share.where((F.col("_mine") >= overlap * F.col("_all")) & (F.col("_theirs") >= overlap * F.col("_all_theirs")))
        kinds = best.select(*keys, F.col("kind").alias("_kind"))
        judged = rest.join(kinds, keys).join(alike.select(*keys, key, F.lit(True).alias("_alike")), [*keys, key], "left")
        left = cut(judged.where(~(F.coalesce("_alike", F.lit(False)) & F.col("kind").eqNullSafe(F.col("_kind")))).drop("_kind", "_alike"))
    return taken
