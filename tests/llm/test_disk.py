"""What the operators leave on disk on their way."""

import os
import time

import pytest

from lacunar.llm import common
from lacunar.sources import shared


def shuffle_files(spark):
    """Names of the shuffle files that the session holds just now."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def settled(look, wanted, seconds=20):
    """What look() says once it is `wanted`, or at the end."""
    until = time.time() + seconds
    while (seen := look()) != wanted and time.time() < until:
        time.sleep(0.2)
    return seen


def folders(spark):
    base = shared.shared_dir(spark).removeprefix("file://")
    return {f"{d}/{x}" for d, names, _ in os.walk(base) for x in names if x.startswith("rdd-")}


@pytest.mark.parametrize("write", [lambda df: shared.cut(df), lambda df: shared.store(df, "rows")])
def test_shuffles_go_with_their_query(spark, write):
    before = shuffle_files(spark)
    rows = write(spark.range(2000).selectExpr("id % 97 as k").groupBy("k").count())
    assert settled(lambda: shuffle_files(spark) - before, set()) == set()
    assert sorted(map(tuple, rows.collect())) == [(k, 20 + (k < 60)) for k in range(97)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_query_read_again_after_its_shuffles_went(spark):
    counted = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    first = sorted(map(tuple, shared.cut(counted).collect()))
    assert sorted(map(tuple, counted.collect())) == first == sorted(map(tuple, shared.cut(counted).collect()))


@pytest.mark.parametrize("broadcast_rows", [1 << 18, 0])
def test_components_leave_two_checkpoints(spark, broadcast_rows):
    """The edges and the last round stay, whatever the number of rounds; a path takes several."""
    before = folders(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i != 150] + [(400, 400)], "a long, b long")
    found = common.components(edges, broadcast_rows=broadcast_rows)
    assert len(folders(spark) - before) == 2
    assert dict(map(tuple, found.collect())) == {i: 0 if i <= 150 else 151 for i in range(301)} | {400: 400}


def test_components_by_either_join(spark):
    """A hub, a path, pairs, loops, repeated edges and null ends: the same by broadcast and by shuffle."""
    rows = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 2), (7, 7), (3, 2), (3, 2), (None, 9), (9, None), (-5, 6000)]
    edges = spark.createDataFrame(rows, "a long, b long")
    got = [dict(map(tuple, common.components(edges, broadcast_rows=n).collect())) for n in (1 << 18, 0)]
    want = {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(41)} | {5000: 0, -5: -5, 6000: -5}
    assert got == [want, want]


def test_components_without_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert list(map(tuple, common.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect())) == [(4, 4)]
