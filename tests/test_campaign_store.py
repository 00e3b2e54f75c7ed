from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from logweave.operators.campaign_store import CampaignStore

START = datetime(2024, 1, 1)
SCHEMA = "window_id string, window_start timestamp, entity_type string, value string"


def _at_once(rows, gap, keep):
    """(root -> windows) of all live windows that share an anchor within the gap."""
    latest = max(r[1] for r in rows)
    live = {r for r in rows if (latest - r[1]).total_seconds() <= keep and r[2] != "ip"}
    parent = {r[0]: r[0] for r in live}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in live:
        for b in live:
            if a[2:] == b[2:] and abs((a[1] - b[1]).total_seconds()) <= gap:
                x, y = sorted((find(a[0]), find(b[0])))
                parent[y] = x
    out = {}
    for w in parent:
        out.setdefault(find(w), set()).add(w)
    return {k: sorted(v) for k, v in out.items() if len(v) > 1}


def _windows(rng, n, first, last):
    out = []
    for _ in range(n):
        at = START + timedelta(hours=rng.randint(first, last))
        out += [(f"w{at:%d%H}-{rng.randint(0, 2)}", at, rng.choice(["user", "host", "ip"]), f"v{rng.randint(0, 9)}") for _ in range(rng.randint(1, 2))]
    return out


def test_batches_end_with_what_all_live_windows_give(spark, tmp_path):
    rng, rows = random.Random(2), []
    store = CampaignStore(spark, f"file:{tmp_path}/store", 10 * 3600, 48 * 3600)
    for k in range(5):
        batch = _windows(rng, 14, max(0, 20 * k - 15), 20 * k + 20) + rows[-3:]  # late windows and known ones
        latest = max(r[1] for r in rows + batch)
        rows += [r for r in batch if (latest - r[1]).total_seconds() <= 48 * 3600]
        store.update(spark.createDataFrame(batch, SCHEMA), k)
        assert {r.root: list(r.window_ids) for r in store.queues().collect()} == _at_once(rows, 10 * 3600, 48 * 3600)
    kinds = {r.kind for r in store.decisions().select("kind").distinct().collect()}
    assert kinds == {"merge", "split", "end"}
    before = store.members().count()
    store.update(spark.createDataFrame(rows[:5], SCHEMA), 4)  # a repeated batch
    assert store.members().count() == before and store.committed()[0] == 4


def test_an_expiring_bridge_splits_a_campaign(spark, tmp_path):
    w = lambda name, hours, value: (name, START + timedelta(hours=hours), "user", value)
    store = CampaignStore(spark, f"file:{tmp_path}/store", 24 * 3600, 24 * 3600)
    store.update(spark.createDataFrame([w("a", 0, "u"), w("a", 0, "v"), w("b", 20, "u"), w("c", 20, "v")], SCHEMA), 0)
    assert [list(r.window_ids) for r in store.queues().collect()] == [["a", "b", "c"]]
    store.update(spark.createDataFrame([w("d", 30, "u")], SCHEMA), 1)
    assert [list(r.window_ids) for r in store.queues().collect()] == [["b", "d"]]
    assert {tuple(r) for r in store.decisions().collect()} == {("split", "a", "b", 1), ("split", "a", "c", 1)}
    assert {(r.window_id, r.root) for r in store.members().collect()} == {("b", "b"), ("c", "c"), ("d", "b")}


def test_an_interrupted_batch_is_written_again(spark, tmp_path, monkeypatch):
    w = lambda name, hours: (name, START + timedelta(hours=hours), "user", "u")
    store = CampaignStore(spark, f"file:{tmp_path}/store", 24 * 3600, 1e6)
    store.update(spark.createDataFrame([w("a", 0)], SCHEMA), 0)
    write = store._write

    def broken(rows, name, batch, *by):
        write(rows, name, batch, *by)
        if name == "entities":
            raise OSError("lost")

    monkeypatch.setattr(store, "_write", broken)
    with pytest.raises(OSError, match="lost"):
        store.update(spark.createDataFrame([w("b", 1)], SCHEMA), 1)
    assert store.committed()[0] == 0 and store.queues().isEmpty()
    monkeypatch.undo()
    store.update(spark.createDataFrame([w("b", 1)], SCHEMA), 1)
    assert [list(r.window_ids) for r in store.queues().collect()] == [["a", "b"]]


def test_empty_and_null_batches(spark, tmp_path):
    store = CampaignStore(spark, f"file:{tmp_path}/store", 60, 60)
    store.update(spark.createDataFrame([], SCHEMA), 0)
    store.update(spark.createDataFrame([(None, START, "user", "u"), ("a", None, "user", "u"), ("b", START, None, None)], SCHEMA), 1)
    assert store.members().isEmpty() and store.committed()[0] == 1
