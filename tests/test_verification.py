"""Verification of all states in one job, against the plain one and on planned variants."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pipewright.plans import tampered
from pipewright.plans.demo import DEMO_OPTIONS, territories
from pipewright.plans.planner import PLAN_SCHEMA, load, plan, verify
from pipewright.plans.verification import valid_states, violations

SF = "/root/testdata/sf0.001"
#: What only one of the two tells: prices of special stretches and what follows from a first fault; and forms of rows.
PLAIN_ONLY = {"WRONG_SPECIAL_INTERVAL_PRICE"}


def test_faults_are_found_by_both():
    blank = dict.fromkeys(c.split()[0] for c in PLAN_SCHEMA.split(", "))
    seen = set()
    for k, (rows, features, codes) in enumerate(tampered.cases()):
        seen |= codes
        if codes & {"NODE_NOT_POINT", "PIPE_NOT_LINE", "MISSING_NODE_REFERENCE", "INVALID_NETWORK:CYCLE", "INVALID_NETWORK:ROOT_OR_CYCLE", "INVALID_NETWORK:CHAMBER_DEGREE"}:
            continue  # the plain check goes on or stops elsewhere
        found = {":".join(c.split(":")[:2]) for c in verify(load(features), [blank | r | {"territory": "1", "variant": 1} for r in rows.values()])}
        assert found - PLAIN_ONLY == codes, k
    assert len(seen) >= 35


def test_planned_variants_are_valid_but_for_what_is_changed(spark):
    features = territories(spark, SF).where("cast(territory AS int) < 6").cache()
    rows = plan(features, DEMO_OPTIONS).cache()
    wrong = rows.withColumn("cost", F.when((F.col("variant") == 1) & (F.col("object_type") == "variant_summary"), 0.0).otherwise(F.col("cost")))
    left = {(r["territory"], r["variant"]) for r in valid_states(wrong, features).collect()}
    assert left and left == {(r["territory"], r["variant"]) for r in rows.where("variant > 1").select("territory", "variant").distinct().collect()}


def test_no_states_and_nulls(spark):
    features = territories(spark, SF).limit(5)
    empty = spark.createDataFrame([], PLAN_SCHEMA)
    assert violations(empty, features).collect() == []
    names = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]
    row = dict.fromkeys(names) | {"territory": "0", "variant": 1}
    rows = [row | {"object_type": "heat_network"}, row | {"object_type": None}, row | {"object_type": "heat_chamber", "id": "x"}, row | {"object_type": "variant_summary", "id": "y", "pending": json.dumps([])}]
    codes = {r["code"] for r in violations(spark.createDataFrame([tuple(r.values()) for r in rows], PLAN_SCHEMA), features).collect()}
    assert {"INVALID_ID", "UNSUPPORTED_OUTPUT_OBJECT", "NODE_NOT_POINT", "PIPE_NOT_LINE", "WRONG_LENGTH", "MISSING_NODE_REFERENCE", "CALCULATED_COST", "SCORE"} <= codes
