"""A real repository through the whole engine; sinks, flags, scores and streams."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import os
import subprocess

import pytest

from commitscope import api
from commitscope.plans import tree
from commitscope.scoring import health as scoring
from commitscope.sinks import writers
from commitscope.sources import git
from commitscope.streaming import incremental


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    top = tmp_path_factory.mktemp("repo")

    def run(*args, day="2025-01-10", who="ann"):
        env = os.environ | {"GIT_AUTHOR_DATE": f"{day}T12:00:00Z", "GIT_COMMITTER_DATE": f"{day}T12:00:00Z"} | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", f"{who}@ex.com"))}
        subprocess.run(["git", "-C", str(top), *args], check=True, env=env, capture_output=True)

    run("init", "-q", "-b", "main")
    (top / "src").mkdir()
    (top / "src/lib.rs").write_text("mod util;\n// TODO(ann): tidy\nfn main() {\n    if true { util::go(); }\n}\n")
    (top / "src/util.rs").write_text("pub fn go() {}\n")
    (top / "Cargo.lock").write_text("x\n")
    (top / "b.bin").write_bytes(b"\0\1\2")
    run("add", "."), run("commit", "-qm", "Start of the work")
    run("checkout", "-qb", "side")
    (top / "src/util.rs").write_text("pub fn go() {}\npub fn more() {}\n")
    run("commit", "-qam", "wip", day="2025-02-01", who="bob")
    run("checkout", "-q", "main")
    run("mv", "src/lib.rs", "src/core.rs")
    run("commit", "-qm", "Move a file\n\nwith a body", day="2025-02-02")
    run("merge", "-q", "--no-ff", "-m", "Merge side", "side", day="2025-02-03")
    (top / "tab\tname \u00e9.py").write_text("import os\n")
    run("add", "."), run("commit", "-qm", "Odd name", day="2025-02-04")
    run("rm", "-q", "b.bin"), run("commit", "-qm", "Remove", day="2025-02-05")
    run("branch", "topic")
    return str(top)


def test_changes(spark, repo):
    rows = git.changes(spark, repo).collect()
    got = {(r.message.split("\n")[0], r.file_path): (r.status, r.additions, r.deletions, r.parent_count, r.email) for r in rows}
    assert got["Start of the work", "src/lib.rs"] == (0, 5, 0, 0, "ann@ex.com") and got["Start of the work", "b.bin"] == (0, 0, 0, 0, "ann@ex.com")
    assert got["wip", "src/util.rs"] == (1, 1, 0, 1, "bob@ex.com") and got["Merge side", "src/util.rs"] == (1, 1, 0, 2, "ann@ex.com")
    assert got["Move a file", "src/core.rs"][0] == 3 and got["Remove", "b.bin"][0] == 2
    assert ("Odd name", "tab\tname \u00e9.py") in got and not any(f == "Cargo.lock" for _, f in got)
    assert next(r.old_path for r in rows if r.status == 3) == "src/lib.rs"


def test_tree_refs_blame_and_ancestors(spark, repo):
    files = {r.path: r for r in git.head_files(spark, repo).collect()}
    assert set(files) == {"Cargo.lock", "src/core.rs", "src/util.rs", "tab\tname \u00e9.py"} and files["src/util.rs"].content.startswith("pub fn go") and not files["src/util.rs"].binary
    refs = {r.name: r for r in git.refs(spark, repo).collect()}
    assert set(refs) == {"main", "side", "topic"} and refs["side"].merged == "yes" and refs["main"].is_head == "yes" and refs["side"].last_commit == dt.date(2025, 2, 1)
    spans = [(r.line_start, r.len, r.author) for r in git.blame(spark, repo, git.head_files(spark, repo).filter("path = 'src/util.rs'")).collect()]
    assert sorted(spans) == [(1, 1, "ann@ex.com"), (2, 1, "bob@ex.com")]
    edges = git.edges(spark, repo)
    head = spark.createDataFrame([(git.git(repo, "rev-parse", "HEAD").decode().strip(),)], "oid string")
    assert tree.ancestors(edges, head).count() == 6


def test_every_report_runs(spark, repo):
    found = api.analyze(spark, repo, only=",".join(api.REPORTS), as_of="2026-01-01")
    assert list(found) == api.REPORTS
    rows = {n: df.collect() for n, df in found.items()}
    assert {r["name"]: r.commits for r in rows["authors"]} == {"ann@ex.com": 5, "bob@ex.com": 1}
    assert [(r.marker, r.owner, r.recommendation) for r in rows["debt_markers"]] == [("TODO", "ann", "stale")]
    assert {r["name"]: r.fan_in for r in rows["fan_in_out"]}["src/util.rs"] == 1
    assert any(r["name"] == "src/util.rs::go" for r in rows["construct_churn"])
    assert {r["name"] for r in rows["health"]} >= {"overall", *scoring.PILLARS}
    assert all(20 <= r.score <= 100 for r in rows["health"] if r.score is not None)
    assert {r["group"] for r in rows["health"]} >= {"overall", "pillars", "insights"} and any(r["name"] == "team" and r.details == "team total=2" for r in rows["health"])


def test_reports_of_the_caller(spark, repo, monkeypatch):
    monkeypatch.setattr(api, "OWN", {})

    @api.report("first_commits")
    def first_commits(tables, as_of):
        return tables.changes.groupBy("email").agg({"commit_ts": "min"}).toDF("name", "first")

    got = api.analyze(spark, repo, "first_commits,authors", as_of="2026-01-01")
    assert list(got) == ["first_commits", "authors"] and got["first_commits"].count() == 2
    assert "first_commits" in api.report_names()
    with pytest.raises(ValueError, match="already"):
        api.report("churn")


def test_time_ranges(spark, repo):
    assert {r["name"] for r in api.analyze(spark, repo, "authors", date_from="2025-02-01", date_to="2025-02-01")["authors"].collect()} == {"bob@ex.com"}
    assert api.analyze(spark, repo, "authors", since="1w", as_of="2025-02-06")["authors"].count() == 2


def test_shallow_clones_are_refused(spark, repo, tmp_path):
    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{repo}", str(tmp_path / "c")], check=True, capture_output=True)
    with pytest.raises(ValueError, match="shallow"):
        git.changes(spark, str(tmp_path / "c"))


def test_files_on_disk(spark, repo):
    assert {r.language for r in tree.quick_composition(git.files_on_disk(spark, repo)).collect()} == {"Rust", "Python"}


def test_names_and_flags():
    assert api.report_names() == [r for r in api.REPORTS if r != "half_life"] and len(api.REPORTS) == 30
    assert api.report_names("module-coupling, TODO,big-files") == ["module_coupling", "debt_markers", "large_sources"]
    for only, message in (("nope", "Unknown report kind: 'nope'"), (" , ", "--only requires at least one report kind")):
        with pytest.raises(ValueError, match=message):
            api.report_names(only)
    assert [api.parse_duration(x) for x in ("30d", "2w", "6m", "1y")] == [30, 14, 180, 365]
    for x in ("", "d", "0d", "-1d", "3x", "xd"):
        with pytest.raises(ValueError):
            api.parse_duration(x)
    for args, message in ((("1d", "2025-01-01", None), "Cannot combine"), ((None, "2025-01-01", None), "--from requires --to"), ((None, None, "2025-01-01"), "--to requires --from"), ((None, "2025-02-01", "2025-01-01"), "must be before"), ((None, "x", "2025-01-01"), "Invalid --from date")):
        with pytest.raises(ValueError, match=message):
            api.time_range(*args)
    assert api.main(["--only", "nope"]) == 2


@pytest.fixture(scope="module")
def reports():
    flat = writers.Report("churn", ["lines", "rate"], [{"group": None, "name": f"f{k}</script>", "lines": k, "rate": k / 3} for k in range(3)])
    grouped = writers.Report("patterns", ["commits"], [{"group": g, "name": n, "commits": 1} for g, n in (("hourly", "01:00"), ("daily", "Mon"), ("daily", "Tue"))])
    return [flat, grouped, writers.Report("age", ["days"], [])]


def test_json(reports):
    out = json.loads(writers.as_json(reports, top=2, at=dt.datetime(2025, 1, 1, tzinfo=dt.UTC)))
    assert out["generated_at"] == "2025-01-01T00:00:00Z"
    churn, patterns = out["reports"]["churn"], out["reports"]["patterns"]
    assert (churn["total_entries"], churn["shown_entries"], len(churn["entries"])) == (3, 2, 2) and "entry_groups" not in churn
    assert [g["name"] for g in patterns["entry_groups"]] == ["hourly", "daily"] and patterns["shown_entries"] == 3 and "entries" not in patterns


def test_csv_table_and_html(reports):
    rows = list(csv.reader(io.StringIO(writers.as_csv(reports[0], top=1))))
    assert rows == [["name", "lines", "rate"], ["f0</script>", "0", "0.00"]]
    assert next(csv.reader(io.StringIO(writers.as_csv(reports[1], top=1)))) == ["group", "name", "commits"] and writers.as_csv(reports[1], top=1).count("\n") == 4
    assert writers.csv_paths("/x/out.csv", ["a"])["a"].as_posix() == "/x/out_a.csv"
    assert "(1 of 3 shown" in writers.as_table(reports[0], 1) and writers.as_table(reports[2]).endswith("(no data)")
    page = writers.as_html(reports)
    assert page.count("</script>") == 2 and "f2<\\/script>" in page
    assert writers.text("no_such_code") == "no_such_code" and writers.text("shown", shown=1, total=2).startswith("(1 of 2")


def test_writers_by_format(reports, tmp_path):
    assert set(writers.WRITERS) == {"table", "json", "csv", "html"}
    assert writers.WRITERS["csv"](reports, 1).startswith("--- churn ---\nname,lines,rate\n") and json.loads(writers.WRITERS["json"](reports, 1))["reports"]
    assert all(isinstance(w(reports), str) for w in writers.WRITERS.values())
    (tmp_path / "texts.json").write_text('{"own": "{{n}} rows"}')
    writers.read_texts(f"{tmp_path}/texts.json")
    assert writers.text("own", n=3) == "3 rows" and writers.text("title") == "Repository analysis"


def test_scores(spark):
    silos = spark.createDataFrame([(f"f{k}", "at_risk") for k in range(10)], "name string, risk string")
    got = {r["name"]: (r.score, r.level) for r in scoring.health({"knowledge_silos": silos}).collect()}
    assert got["bus_factor"] == (80.0, "ok") and got["overall"] == (96.0, "ok") and "architecture" not in got
    many = spark.createDataFrame([(f"f{k}", 30) for k in range(40)], "name string, cyclomatic long")
    got = {r["name"]: r.score for r in scoring.health({"complexity": many}).collect()}
    assert got["refactoring_debt"] == 50.0
    with pytest.raises(ValueError):
        scoring.health({})
    many = many.withColumn("lines", many["cyclomatic"])
    assert [(r["name"], r.details) for r in scoring.findings({"complexity": many}).collect()] == [(f"refactoring_debt: f{k}", "high_complexity cc=30 lines=30") for k in (0, 1, 10)]


def test_streams(spark, tmp_path):
    schema = "commit_oid string, commit_ts timestamp, email string, additions long, deletions long"
    rows = [("a", dt.datetime(2025, 1, 6, 10), "x", 1, 0), ("a", dt.datetime(2025, 1, 6, 10), "x", 2, 0), ("b", dt.datetime(2025, 1, 12, 23), "x", 3, 1), ("c", dt.datetime(2025, 1, 13), "y", 5, 5)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")

    def run(plan, name):
        q = plan(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    later = [("z", dt.datetime(2025, 6, 1), "x", 1, 0)]  # moves the watermark past the weeks before
    spark.createDataFrame(later, schema).write.mode("append").parquet(f"{tmp_path}/in")
    weekly = {str(r.week): (r.commits, r.lines_changed) for r in run(incremental.weekly_velocity, "weekly")}
    assert weekly == {"2025-01-06": (2, 7), "2025-01-13": (1, 10)}
    assert sorted(r.commit_oid for r in run(incremental.first_rows, "firsts")) == ["a", "b", "c", "z"]
    assert len(incremental.author_sessions(spark.createDataFrame(rows, schema)).collect()) == 3
    churn = incremental.file_churn(spark.createDataFrame([("f", 1, 2), ("f", 3, 4), ("g", 5, 0)], "file_path string, additions long, deletions long"))
    assert {tuple(r) for r in churn.collect()} == {("f", 4, 6, 10), ("g", 5, 0, 5)}


def test_sizes_are_those_of_the_blobs(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    run("init", "-q")
    data = bytes((k * 7 + 128) % 256 or 1 for k in range(400_000))  # no NUL, no UTF-8
    (tmp_path / "raw.dat").write_bytes(data)
    (tmp_path / "nul.dat").write_bytes(b"a\0b")
    (tmp_path / "x.py").write_text("x = 1\n")
    (tmp_path / "link.py").symlink_to("x.py")
    run("add", "."), run("commit", "-qm", "one")
    files = {r.path: r for r in git.head_files(spark, str(tmp_path)).collect()}
    assert (files["raw.dat"].size, files["raw.dat"].binary, files["raw.dat"].content) == (400_000, True, None)
    assert files["nul.dat"].binary and not files["x.py"].binary and "link.py" not in files
    table = git.head_files(spark, str(tmp_path))
    got = {r["name"]: (r.files, r.bytes) for r in tree.composition(table).collect()}
    assert got == {"Python": (1, 6), "(binary/skipped)": (2, 0)}
    assert tree.bloat(table).count() == 0
    assert list(git.blobs(str(tmp_path), [files["raw.dat"].oid, files["x.py"].oid], 1000)) == [None, b"x = 1\n"]
    assert git.git_folder(str(tmp_path))["loose"] > 3


def test_markers_behind_code_and_long_texts(spark):
    text = 'x = 1  # TODO: later\ny = "FIXME in a string"\n# hack(me) - ' + "\u00e9" * 100 + "\n"
    files = spark.createDataFrame([("a.py", text), ("b.unknown", "# TODO: nothing")], "path string, content string")
    got = sorted((r["name"], r.marker, r.owner, r.text) for r in tree.debt_markers(files).collect())
    assert got == [("a.py:1", "TODO", "", "later"), ("a.py:3", "HACK", "me", "\u00e9" * 60 + "\u2026")]


def test_ancestors_over_merges_and_long_chains(spark):
    import random

    rng = random.Random(3)
    edges = [(k, k - 1) for k in range(1, 400)] + [(k, rng.randrange(k)) for k in range(300, 400, 3)] + [(1000 + k, 1000 + k - 1) for k in range(1, 150)] + [(1149, 77)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    want, todo = set(), [1149, 350]
    while todo:
        if (x := todo.pop()) not in want:
            want.add(x)
            todo += up.get(x, ())
    frame = spark.createDataFrame(edges, "oid long, parent long")
    got = [r.oid for r in tree.ancestors(frame, spark.createDataFrame([(1149,), (350,)], "oid long")).collect()]
    assert sorted(got) == sorted(want)
