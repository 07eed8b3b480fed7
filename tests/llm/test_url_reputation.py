"""Host reputation against SQL, the rules by hand, and shrinkage in plain Python."""

from __future__ import annotations

import pytest

from commitscope.llm import url_reputation as u


@pytest.fixture
def pages(spark):
    return lambda urls, **extra: spark.createDataFrame([(k, x, "", *extra.values()) for k, x in enumerate(urls)], "page_id long, url string, html string" + "".join(f", {k} string" for k in extra))


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "page_id long, bad int")


def test_query_is_sql(spark, data, duck, rows):
    assert rows(u.op5_urls(spark, data)) == duck(u.SQL, data, "pages", "labels")


CASES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"), ("https://ORG/", "org", "/", "org/", "allow"), ("http://www.example.org/es/a?b", "www.example.org", "/es/a", "example.org/es/", "block"),
    ("http://Example.ORG/en/17", "example.org", "/en/17", "example.org/en/1", "block"), ("http://example.org/en/2#x", "example.org", "/en/2", "org/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"), ("http://a.com/FR/", "a.com", "/FR/", None, "allow"),
    ("http://a.com", "a.com", "", None, "allow"), ("http://a.org?x/y", "a.org", "", None, "allow"), ("no scheme/a.org/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://a.com?u=http://b.com/de/x", "a.com", "", None, "allow"), ("http://a.com#http://b.com/de/x", "a.com", "", None, "allow"), ("http://me:pw@a.com:8080/de/", "me:pw@a.com:8080", "/de/", None, "allow"),
    ("http://a.b://c.org/es/", "a.b:", "//c.org/es/", None, "allow"), ("x://\u0130.org/\n/es", "\u0130.org", "/\n/es", "org/", "allow"), ("://org/", "org", "/", "org/", "allow"),
]


def test_rules(pages, labels):
    got = sorted(u.judge(pages([c[0] for c in CASES], host="h", path="p", bad="b", n="n"), labels([])).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [c[1:] for c in CASES]


def test_reputation_shrinks_and_falls_back(pages, labels):
    urls = [f"http://{h}.net/{k}" for h, n in (("bad.spam", 30), ("new.spam", 3), ("few.spam", 1), ("good.fine", 30), ("odd.fine", 1)) for k in range(n)]
    bad = lambda x: int("spam" in x or "odd" in x)
    outcomes = [(k, bad(x)) for k, x in enumerate(urls) if "new" not in x] + [(0, None), (None, 1), (999, 1)]
    got = {r.host: r.verdict for r in u.judge(pages(urls), labels(outcomes)).collect()}
    assert got == {"bad.spam.net": "block", "new.spam.net": "block", "few.spam.net": "block", "good.fine.net": "allow", "odd.fine.net": "allow"}


def test_odd_tables(pages, labels):
    assert u.judge(pages([]), labels([(1, 1)])).count() == 0
    repeated = pages(["http://x.net/a"]).unionByName(pages(["http://x.net/a"]))
    assert u.judge(repeated, labels([(0, 1), (0, 0)])).count() == 2
    assert [r.verdict for r in u.judge(pages(["http://x.net/" + "a" * 200_000]), labels([])).collect()] == ["allow"]


def test_suffixes(spark, tmp_path):
    rows = [("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk", "b.co.uk", "co.uk"), ("x.example.com", "example.com", "com"), ("localhost", "localhost", "localhost"), ("", "", ""), ("co.uk", "co.uk", "co.uk")]
    df = spark.createDataFrame([(h,) for h, _, _ in rows], "host string")
    found = u.with_domain(df, u.default_suffixes(spark)).collect()
    assert {(r.host, r.domain, r.suffix) for r in found} == set(rows) and len(found) == len(rows)
    (tmp_path / "list.dat").write_text("// a list\n\nuk\nco.uk\n*.ck\n!www.ck\nblogs.example.com extra\n")
    full = u.read_suffixes(spark, f"{tmp_path}/list.dat")
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "a.x.ck": ("a.x.ck", "x.ck"), "b.a.x.ck": ("a.x.ck", "x.ck"), "www.ck": ("www.ck", "ck"), "a.www.ck": ("www.ck", "ck"), "me.blogs.example.com": ("me.blogs.example.com", "blogs.example.com")}
    got = u.with_domain(spark.createDataFrame([(h,) for h in hosts], "host string"), full).collect()
    assert {r.host: (r.domain, r.suffix) for r in got} == hosts


def test_unlabelled_domains_take_their_suffix(pages, labels):
    urls = [f"http://h.d{d}.{s}/{k}" for s in ("bad", "fine") for d in range(20) for k in range(10)]
    outcomes = [(k, int(".bad/" in x)) for k, x in enumerate(urls)]
    urls += ["http://new.other.bad/", "http://new.other.fine/", "http://new.other.unseen/"]
    got = {r.host: r.verdict for r in u.judge(pages(urls), labels(outcomes)).collect()}
    assert [got[f"new.other.{s}"] for s in ("bad", "fine", "unseen")] == ["block", "allow", "allow"]
    mostly = [(k, 1) for k, _ in outcomes[:200]]
    got = {r.host: r.verdict for r in u.judge(pages([*urls, "no scheme"]), labels(mostly)).collect()}
    assert got["new.other.unseen"] == "block" and got[""] == "allow"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes pages and labels as tables of a folder."""

    def write(urls, outcomes):
        spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
        rows = [(k, None if bad is None else 1 - bad, 0) for k, bad in outcomes]
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
        return f"{tmp_path}"

    return write


def test_query_is_sql_where_the_method_blocks(spark, folder, rows):
    import random

    import duckdb

    rng = random.Random(4)
    rate = {f"h{h}.d{d}.{s}": rng.random() ** (2 if d % 3 else 0.2) for s in ("net", "info", "co.uk") for d in range(12) for h in range(4)}
    urls = [f"http://{rng.choice(list(rate))}/{k}?u=http://b.com/de/" for k in range(1500)] + [None, "none", "http://new.d3.net/", "http://a.fresh.info/x", "http://a.unseen/", "http://x.org/", "http://x.com/de/1"]
    outcomes = [(k, int(rng.random() < rate[x.split("/")[2]])) for k, x in enumerate(urls[:1200])] + [(0, None), (5, 1)]
    data = folder(urls, outcomes)
    got = rows(u.op5_urls(spark, data))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet/*.parquet')")
    found = con.execute(u.SQL)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)
    blocked = [r for r in got if r[-1] == "block" and r[3] is None]
    assert 100 < len(blocked) < 1400


def test_plan_is_small(spark, data):
    plan = u.op5_urls(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 12
