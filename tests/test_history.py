"""History reports on literal fixtures."""

from __future__ import annotations

import datetime as dt

import pytest

from commitscope.plans import history


@pytest.fixture
def changes(spark):
    def build(rows):
        """rows: (commit, day, email, file, status, additions, deletions[, message[, parents]])"""
        full = [(c, dt.datetime.fromisoformat(d), e, (rest[0] if rest else "change"), f, s, a, x, (rest[1] if len(rest) > 1 else 1)) for c, d, e, f, s, a, x, *rest in rows]
        return spark.createDataFrame(full, "commit_oid string, commit_ts timestamp, email string, message string, file_path string, status int, additions long, deletions long, parent_count int")

    return build


def one(df):
    return {r["name"]: r for r in df.collect()}


def test_coupling(changes):
    rows = [(f"c{k}", "2025-01-01", "a", f, 1, 1, 0) for k in range(3) for f in ("src/a.rs", "src/b.rs")]
    (r,) = history.coupling(changes(rows)).collect()
    assert (r["name"], r.co_changes, r.score) == ("src/a.rs <-> src/b.rs", 3, 1.0)
    assert history.coupling(changes(rows[:4])).count() == 0
    assert history.coupling(changes(rows + [(f"d{k}", "2025-01-01", "a", "src/a.rs", 1, 1, 0) for k in range(8)])).count() == 0


def test_age_leaves_deleted_files_out(changes):
    rows = [("1", "2024-01-01", "a", "alive.rs", 0, 5, 0), ("2", "2024-06-01", "a", "alive.rs", 1, 5, 0), ("1", "2024-01-01", "a", "gone.rs", 0, 1, 0), ("3", "2024-02-01", "a", "gone.rs", 2, 0, 1)]
    found = one(history.age(changes(rows), as_of="2024-12-31"))
    assert set(found) == {"alive.rs"} and found["alive.rs"].age_days == 365 and found["alive.rs"].days_since_last_change == 213


def test_patterns(changes):
    rows = [("1", "2025-01-13T14:00:00", "a", "x.rs", 1, 1, 0), ("1", "2025-01-13T14:00:00", "a", "y.rs", 1, 1, 0), ("2", "2025-01-12T03:00:00", "a", "x.rs", 1, 1, 0)]
    found = one(history.patterns(changes(rows)))
    assert found["14:00"].commits == 1 and found["Mon"].commits == 1 and found["Sun"].commits == 1 and len(found) == 31


def test_bus_factor(changes):
    def factor(*lines):
        rows = [(str(k), "2025-01-01", f"dev{k}", "a.rs", 1, n, 0) for k, n in enumerate(lines)]
        return history.ownership(changes(rows)).first().bus_factor

    assert [factor(10), factor(10, 10), factor(10, 10, 10), factor(0, 0)] == [1, 2, 2, 0]


def test_pareto(changes):
    rows = [(str(k), "2025-01-01", "a", f"f{k}.rs", 1, n, 0) for k, n in enumerate((80, 5, 5, 5, 5))]
    s = one(history.churn_pareto(changes(rows)))["<summary>"]
    assert (s.p50, s.p80, s.p90) == (1, 1, 3)


def test_commit_size(changes):
    rows = [(str(n), "2025-01-01", "a", "f.rs", 1, n, 0) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 100)]
    s = one(history.commit_size(changes(rows)))["overall"]
    assert (s["max"], s.p95, s["mean"]) == (100, 100, 15)


def test_outlier_classes(changes):
    rows = [(f"h{k}", "2025-01-01", "a", "src/often.rs", 1, 1, 0) for k in range(100)] + [(f"d{k}", "2025-01-01", f"dev{k}", "src/many.rs", 1, 1, 0) for k in range(5)]
    found = one(history.outliers(changes(rows)))
    assert {n: r.recommendation for n, r in found.items()} == {"src/often.rs": "high_churn", "src/many.rs": "diffuse_ownership"}


def test_silos(changes):
    rows = [("1", "2025-01-01", "idle", "a.rs", 1, 100, 0), ("2", "2025-11-01", "busy", "b.rs", 1, 100, 0), ("3", "2025-11-01", "x", "c.rs", 1, 50, 0), ("4", "2025-11-01", "y", "c.rs", 1, 50, 0)]
    found = one(history.knowledge_silos(changes(rows), as_of="2025-12-01"))
    assert {n: r.risk for n, r in found.items()} == {"a.rs": "at_risk", "b.rs": "single_owner"}


def test_quality_rows(changes):
    rows = [("1", "2025-01-01", "a", "a.rs", 1, 2000, 0, "wip"), ("2", "2025-01-01", "a", "a.rs", 1, 1, 0, 'Revert "x"', 2), ("3", "2025-01-01", "a", "a.rs", 1, 1, 0, "A long enough message"), ("4", "2025-01-01", "a", "a.rs", 1, 1, 0, None)]
    found = {n: r.commits for n, r in one(history.quality(changes(rows))).items()}
    assert found["total_commits"] == 4 and found["mega_commits"] == 1 and found["revert_commits"] == 1 and found["merge_commits"] == 1 and found["short_messages"] == 2


def test_empty_history(changes):
    for name in ("authors", "churn", "ownership", "coupling", "module_coupling", "outliers", "churn_pareto", "commit_velocity"):
        assert getattr(history, name)(changes([])).count() == 0, name


def test_time_range(changes):
    df = changes([(str(k), f"2025-0{k}-01", "a", "a.rs", 1, 1, 0) for k in range(1, 7)])
    assert history.time_range(df, start="2025-02-01", end="2025-04-01").count() == 3
    assert history.time_range(df, since_days=31, as_of="2025-06-01").count() == 2
