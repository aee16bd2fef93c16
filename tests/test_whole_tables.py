"""Queries that are to take in every row of their main table."""

import os

import pytest

from tallyloom.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_every_event_is_compared(spark):
    assert sum(r.n for r in QUERIES["paired_compare_all"](spark, DATA).collect()) == spark.read.parquet(f"{DATA}/events.parquet").count()
