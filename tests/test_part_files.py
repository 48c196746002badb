"""Texts that the writer left in several part files."""

import pytest

from tests.check import compare, duck
from tidemark.catalog import cases
from tidemark.session import scratch_path
from tidemark.sources import readers as rd
from tidemark.sources import sinks as sk

BASE = "/root/testdata/sf0.001"


@pytest.fixture
def uncoalesced(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_numbers_go_on_from_part_to_part(uncoalesced):
    rows = uncoalesced.createDataFrame([(k, i, 0, f"{k}:{i}") for k in (1, 2) for i in range(40)], "k long, seg_no long, part int, line string")
    path = scratch_path(uncoalesced, "texts")
    sk.write_text(rows, path, "k", ["seg_no", "part"])
    out = rd.read_lines(uncoalesced, path, numbered=True, parts=True).collect()
    assert len({r["file"] for r in out}) > 2
    assert sorted((r["line_no"], r["line"]) for r in out) == sorted((i, f"{k}:{i}") for k in (1, 2) for i in range(40))


@pytest.mark.parametrize("name", ["s1_numbered_lines", "s4_list_media"])
def test_query_equals_sql_over_part_files(uncoalesced, name):
    case = cases()[name]
    assert compare(duck(BASE), case.run(uncoalesced, BASE), case.sql) is None


def test_listing_setting_is_restored(spark):
    before = spark.conf.get(rd.LISTING)
    with pytest.raises(ValueError), rd.few_listing_tasks(spark):
        assert int(spark.conf.get(rd.LISTING)) < int(before)
        raise ValueError
    assert spark.conf.get(rd.LISTING) == before
