"""Roll-ups over forests of edges child -> parent by pointer doubling.

A node keeps one pointer, to its ancestor 2**n edges up, and what it has gathered from its descendants
less than 2**n edges down. A round adds what the nodes that point at it have gathered and doubles the
pointers, so a forest of depth d takes about log2(d) rounds of as many rows as it has nodes, also
where it is one long chain. Rows are dealt in as many partitions as they need; those whose pointer has ended
are joined by their node alone, as all would have the same null for a key. A cycle raises ValueError.

Each of these rounds moves all rows. So where there are many, nodes that have none below hand what they
have to their parents first and are done with, as long as that is a good part of those that are left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright import session
from pipewright.session import cut, joined, portions, portions_for


def _stripped(edges: DataFrame, gathered: str, of_one: Column, aggregate, merge, parts: int, match: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame | None, int]:
    """edges(node, up, gathered, *match, ...) -> edges that have gathered all, those that are left (if any), and partitions for these.

    Edges without children give aggregate(of_one) to their parents, again and again, as long as they are a quarter of
    the rows at least and these are more than a partition holds. match: columns in which a child equals its parent, or
    is none. Where nodes come twice, or have null to add to, none is taken: what they get depends on the way that they get it."""
    spark, key, parent = edges.sparkSession, ["node", *match], [F.col("up").alias("node"), *match]
    children = edges.groupBy(*parent).agg(F.count(F.lit(1)).alias("_n"))
    state = cut(joined(edges, children, key, parts, "left").withColumn("_waits", F.coalesce("_n", F.lit(0))).drop("_n"))
    odd = state.groupBy("node").agg(F.count("node").alias("n"), F.count_if(F.col(gathered).isNull() & (F.col("_waits") > 0)).alias("unknown")).where("n > 1 OR unknown > 0")
    done: list[DataFrame] = []
    if not odd.isEmpty():
        return done, state.drop("_waits"), parts
    while True:
        rows, ends = state.agg(F.count(F.lit(1)), F.count_if(F.col("_waits") == 0)).first()
        if rows == ends:
            return [*done, state.drop("_waits")], None, parts
        few = rows <= session.PORTION
        parts = 0 if few else portions_for(spark, rows)
        if few or 4 * ends < rows:
            return done, state.drop("_waits"), parts
        leaves = state.where("_waits = 0")
        done.append(leaves.drop("_waits"))
        given = leaves.groupBy(*parent).agg(aggregate(of_one).alias("_given"), F.count(F.lit(1)).alias("_n"))
        inner = joined(state.where("_waits > 0"), given, key, parts, "left")
        state = cut(inner.withColumns({gathered: merge(F.col(gathered), F.col("_given")), "_waits": F.col("_waits") - F.coalesce("_n", F.lit(0))}).drop("_given", "_n"))


def _rounds(state: DataFrame, added: Sequence[str], carried: Sequence[str], gathered: str, of_one: Column, aggregate, merge, parts: int) -> DataFrame:
    """state(node, jump, *added, *carried, gathered) -> the same when no pointer is left.

    added: columns that are summed up over the way to the node pointed at.
    gathered: the column to which a round merges aggregate(of_one), by the node pointed at."""
    state, left = cut(state), None
    while True:
        open_ = state.where("jump IS NOT NULL")
        count = open_.count()
        if left is None:
            left = count
        if not count:
            return state
        if not left:  # paths are longer than there are edges
            raise ValueError("the links have a cycle")
        left //= 2
        given = open_.groupBy(F.col("jump").alias("node")).agg(aggregate(of_one).alias("_given"))
        further = state.select(F.col("node").alias("jump"), F.col("jump").alias("_next"), *(F.col(c).alias(f"_more_{c}") for c in added))
        moved = joined(open_, further, ["jump"], parts, "left").select("node", F.col("_next").alias("jump"), *((F.col(c) + F.col(f"_more_{c}")).alias(c) for c in added), *carried, gathered)
        everyone = joined(moved.unionByName(state.where("jump IS NULL")), given, ["node"], parts, "left")
        state = cut(everyone.select("node", "jump", *added, *carried, merge(F.col(gathered), F.col("_given")).alias(gathered)))


def _start(edges: DataFrame, parts: int, *columns: str) -> DataFrame:
    """node, jump (its parent, if that has an edge too), columns."""
    known = edges.select(F.col("node").alias("up"), F.col("node").alias("jump"))
    return joined(edges, known, ["up"], parts, "left").select("node", "jump", *columns)


def _dealt(edges: DataFrame, parts: int | None) -> int:
    """parts, by default by the number of edges; 0: as Spark does, as one partition holds them."""
    if parts is not None:
        return parts
    rows = edges.count()
    return portions_for(edges.sparkSession, rows) if rows > session.PORTION else 0


def _together(done: list[DataFrame], columns: Sequence[str], parts: int) -> DataFrame:
    """The columns of all that are done, in ``parts`` partitions at most (0: as they are)."""
    found = reduce(DataFrame.unionByName, [x.select(*columns) for x in done])
    return found.coalesce(parts) if parts else found


def subtree_sum(edges: DataFrame, value: str, parts: int | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """edges(node, up, value) -> node, *kept, total: value summed over the node and all below it.

    parts, here and below: how many partitions rows are dealt in (by default by their number).
    kept, here and below: columns of edges that come along, as if joined with them by the node."""
    add = lambda own, given: own + F.coalesce(given, F.lit(0.0))
    parts = _dealt(edges, parts)
    left = edges.select(*dict.fromkeys(["node", "up", *kept]), F.col(value).alias("total"))
    done, few = [], parts
    if parts:
        done, left, few = _stripped(left, "total", F.col("total"), F.sum, add, parts)
    if done:  # nodes come once
        if left is not None:
            done.append(_rounds(_start(left, few, *kept, "total"), [], kept, "total", F.col("total"), F.sum, add, few))
        found = _together(done, ["node", *kept, "total"], parts)
        return found.where("node IS NOT NULL") if kept else found
    found = _rounds(_start(left, parts, "total"), [], [], "total", F.col("total"), F.sum, add, parts).select("node", "total")
    return left.select("node", *kept).join(found, "node") if kept else found


def longest_run(edges: DataFrame, same: str, parts: int | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """edges(node, up, length, same) -> node, *kept (other than length), run: the longest way down from the edge over edges with an equal value."""
    best = lambda own, given: F.greatest(own, given)
    run = F.col("length") + F.col("below")
    parts = _dealt(edges, parts)
    left = edges.select(*dict.fromkeys(["node", "up", "length", same, *kept]), F.lit(0.0).alias("below"))
    done, few = [], parts
    if parts:
        done, left, few = _stripped(left, "below", run, F.max, best, parts, [same])
    carried = kept if done else []  # nodes come once, if any is done
    found = [x.select("node", *carried, run.alias("run")) for x in done]
    if left is not None:
        up = left.select(F.col("node").alias("up"), F.col(same).alias("us"))
        links = joined(left, up, ["up"], few, "left").select("node", F.when(F.col(same) == F.col("us"), F.col("up")).alias("jump"), "length", F.col("length").alias("own"), *carried, "below")
        found.append(_rounds(links, ["length"], ["own", *carried], "below", run, F.max, best, few).select("node", *carried, (F.col("own") + F.col("below")).alias("run")))
    if done:
        found = _together(found, ["node", *kept, "run"], parts)
        return found.where("node IS NOT NULL") if kept else found
    return left.select("node", *kept).join(found[0], "node") if kept else found[0]


def roots(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """edges(node, up) -> node, root: the end of the way up, which has no edge of its own."""
    state, size = cut(edges.select("node", F.col("up").alias("root"))), None
    parts = portions(state) if parts is None else parts
    while True:
        further = joined(state, state.select(F.col("node").alias("root"), F.col("root").alias("_further")), ["root"], parts, "left")
        after = cut(further.select("node", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        moved = after.where("_moved").count()
        if not moved:
            return after.select("node", "root")
        size = moved if size is None else size // 2
        if not size:
            raise ValueError("the links have a cycle")
        state = after.drop("_moved")


def cyclic(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """edges(node, up), a node once -> node: those whose way up never ends. Raises nothing.

    After n rounds of doubling every way of up to 2**n edges has ended; if a round ends none, the rest goes in circles."""
    known = edges.select(F.col("node").alias("up"), F.col("node").alias("jump"))
    parts = portions(edges) if parts is None else parts
    open_ = cut(joined(edges, known, ["up"], parts, "left").select("node", "jump").where("jump IS NOT NULL"))
    left = open_.count()
    while left:
        after = cut(joined(open_, open_.select(F.col("node").alias("jump"), F.col("jump").alias("_next")), ["jump"], parts, "left").where("_next IS NOT NULL").select("node", F.col("_next").alias("jump")))
        count = after.count()
        if count == left:
            break
        open_, left = after, count
    return open_.select("node")
