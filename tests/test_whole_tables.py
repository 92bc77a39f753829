"""Queries read all of their tables."""

import os

import pytest

from tidemark.plans import registry
from tidemark.sources.tables import events, table

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def test_whole_tables(spark):
    run = lambda name: registry.queries()[name](spark, DIR)
    e = events(spark, DIR)
    kills = {r[0] for r in e.filter("type = 'kill'").select("event_id").collect()}
    assert {int(i) for r in run("q_project").collect() for i in r["event_ids"].split(",")} == kills
    assert run("q_music_interval").count() == e.select("source_id").distinct().count()
    labels = table(spark, DIR, "embeddings").select("label").distinct().count()
    assert run("q_seq_similarity").count() == labels * (labels - 1) // 2
