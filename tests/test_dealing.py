"""Signals are dealt by their number of rows, so that a task's memory doesn't grow with the table."""

import pytest
from pyspark.sql import functions as F

from strideframe.plans import jobs
from strideframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def most(df):
    """The most rows that a task has."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("name", ["foot_trail", "contact_flag"])
def test_a_task_has_its_share_of_a_larger_table(spark, monkeypatch, name):
    monkeypatch.setattr(jobs, "SIGNALS", 2_000, raising=False)
    df = QUERIES[name](spark, DATA)
    assert df.count() == 20_000
    assert most(df) < 2 * 2_000


def test_frames_of_ranges_are_dealt_alike(spark, monkeypatch):
    monkeypatch.setattr(jobs, "SIGNALS", 100, raising=False)
    df = QUERIES["ground_contacts"](spark, DATA)
    asked = []
    plain = jobs.parts
    monkeypatch.setattr(jobs, "parts", lambda s, n: asked.append(n) or plain(s, n))
    again = QUERIES["ground_contacts"](spark, DATA)
    assert asked == [df.count()] and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_few_rows_need_few_tasks(spark):
    assert jobs.parts(spark, 0) == jobs.parts(spark, 9_000) == 1
    assert jobs.parts(spark, 100 * jobs.SIGNALS) == 100
    assert jobs.parts(spark, jobs.SIGNALS) == spark.sparkContext.defaultParallelism
