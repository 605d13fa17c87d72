import os
import re

import pytest

import __spark_entry__ as entry
from gramlode.plans.oracles import ORACLES
from gramlode.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_queries_against_their_twins(spark):
    import check

    assert check.compare(spark, FOLDER, list(QUERIES)) == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
def test_entry(spark, explain):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "tech", "base", "n"] and df.count() > 0
    shown = explain(df)
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", shown)
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from gramlode.session import scratch_dir

    def session(master, folder):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda *_: folder),
            sparkContext=SimpleNamespace(master=master, applicationId="a-1"),
        )

    assert scratch_dir(session("yarn", "hdfs://n/x/")) == "hdfs://n/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session("yarn", None))
    assert os.path.isdir(scratch_dir(session("local[2]", None)))
