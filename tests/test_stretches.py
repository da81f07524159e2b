"""Feeds that are only counted are written in stretches."""

import os

import pytest
from pyspark.sql import functions as F

from racelab.plans import registry, sessions
from racelab.sources import records

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["feed_health", "feed_types"])
def test_one_stretch_of_the_feed_is_kept_at_a_time(spark, monkeypatch, name):
    whole = sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()))
    seen, inner = [], sessions._written

    def watched(*args):
        assert not any(os.path.exists(p) for p in seen)
        seen.append(inner(*args))
        return seen[-1]

    monkeypatch.setattr(sessions, "_written", watched)
    monkeypatch.setattr(sessions, "_STRETCH_ROWS", 2000)
    assert sorted(map(tuple, registry.QUERIES[name](spark, SF).collect())) == whole
    assert len(seen) == 3 and not any(os.path.exists(p) for p in seen)


def test_a_part_that_cannot_be_read_blocks_the_feed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"record_type": "RA", "text": "x"}\n')
    good = str(tmp_path)
    got = records.health(spark, [good, good]).first()
    assert (got.records, got.ra, got.status, got.code) == (2, 2, "ready", None)
    got = records.health(spark, iter([good, str(tmp_path / "none")])).first()
    assert (got.records, got.ra, got.status) == (0, 0, "blocked") and got.code is not None
    assert records.health(spark, [good]).select(F.col("code")).first().code is None
