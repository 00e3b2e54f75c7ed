"""The whole chain over a small log with known counts."""

from __future__ import annotations

import pytest

from logweave.plans.log_pipeline import preprocess, run_log_pipeline

LOG = """2026-03-09T08:01:00Z User Dana logged in to Host-K success
2026-03-09T08:02:30Z Process python.exe started on Host-K by User Dana
2026-03-09T08:04:00Z User Dana read /srv/data/plan.csv on Host-K
2026-03-09T08:13:00Z Process python.exe connected to 198.51.100.7 from Host-K
2026-03-09T08:31:00Z User Omar logged in to Host-M failure
2026-03-09T08:32:00Z User Omar logged in to Host-M success
2026-03-09T08:47:00Z Process curl.exe connected to 198.51.100.7 from Host-M
2026-03-09T09:05:00Z User Dana downloaded /srv/data/next.csv on Host-K
no time here
"""


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "source.log"
    path.write_text(LOG)
    return run_log_pipeline(spark, str(path), "own")


def test_counts(run, rows):
    assert (run.raw.count(), run.frames.count(), run.quarantine.count()) == (9, 8, 1)
    assert run.quarantine.first().quarantine_reason == "missing_timestamp"
    assert rows(run.edges.groupBy("role").count()) == [("actor_of", 6), ("destination_of", 10), ("object_of", 2), ("process_of", 3)]
    assert rows(run.entities.groupBy("entity_type").count()) == [("file", 2), ("host", 2), ("ip", 2), ("process", 3), ("user", 2)]
    assert (run.nodes.count(), run.edges.count()) == (19, 21)
    assert [r.history_size for r in run.histories.orderBy("ts").collect()] == list(range(8))


def test_windows_and_links(run, rows):
    assert [r.event_count for r in run.micro.orderBy("window_start").collect()] == [3, 1, 2, 1, 1]
    assert [r.event_count for r in run.macro.orderBy("window_start").collect()] == [4, 3, 1]
    minute = {r.window_id: 60 * (r.window_start.hour - 8) + r.window_start.minute for r in run.micro.collect()}
    rejected = [(minute[r.source_window], minute[r.target_window]) for r in run.pairs.where("rejected_reason is not null").collect()]
    assert rejected == [(10, 45)]
    links = {(minute[r.source_window], minute[r.target_window]): r.anchor_strength for r in run.links.collect()}
    assert links == {(0, 10): "strong", (0, 65): "strong", (10, 65): "medium", (30, 45): "medium"}
    queues = sorted(sorted(minute[w] for w in r.window_ids) for r in run.queues.collect())
    assert queues == [[0, 10, 65], [30, 45]] and sorted(r.queue_id for r in run.queues.collect()) == ["attack_queue_0000", "attack_queue_0001"]


def test_features(run):
    got = run.features.collect()
    assert len(got) == 8 and all(r.graph_score == pytest.approx(21 / 19) and r.long_horizon_score == max(r.micro_window_score, r.macro_window_score) for r in got)
    assert all(len(r.event_embedding) == 32 == len(r.graph_embedding) for r in got)


def test_simple_path(run):
    out = preprocess(run.raw)
    assert out["frames"].count() == 9 and out["edges"].where("relation = 'has_action'").count() == 9
