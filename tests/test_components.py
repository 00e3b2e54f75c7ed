from __future__ import annotations

import os
import random

import pytest

from logweave.operators.components import components
from logweave.operators.numbering import dense_position


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_components(spark, kind):
    r = random.Random(3)
    edges = {"random": [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)], "chain": [(i, i + 1) for i in r.sample(range(40), 40)], "star": [(7, i) for i in range(30)], "empty": []}[kind]
    df = spark.createDataFrame([*edges, (5, 5), (None, 3), (4, None)], "src long, dst long")
    assert {x.node: x.root for x in components(df).collect()} == brute(edges)


def test_components_of_names(spark):
    df = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {x.node: x.root for x in components(df).collect()} == {"b": "a", "c": "a", "y": "x"}


def test_dense_position(spark):
    r = random.Random(1)
    values = [r.randint(0, 50) for _ in range(500)]
    got = dense_position(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), ["v"]).orderBy("position").collect()
    assert [x.position for x in got] == list(range(500)) and [x.v for x in got] == sorted(values)
    assert dense_position(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def test_scopes_of_other_threads_are_their_own(spark):
    import threading

    from logweave.operators.pinning import pin_table, scratch

    kept, ready, go = [], threading.Event(), threading.Event()

    def other():
        ready.wait(60)
        kept.append(pin_table(spark.range(3), "other"))
        go.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        mine = pin_table(spark.range(2), "mine")
        ready.set()
        assert go.wait(120) and mine.count() == 2
        file = mine.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(file)
    thread.join()
    assert kept[0].count() == 3 and not os.path.exists(file)
