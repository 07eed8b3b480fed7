"""Steps that must not grow with the splits of their input, and plans that must not do their work twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitscope import cluster
from commitscope.operators import structure
from commitscope.plans import catalog, tree
from commitscope.sources import synthetic


def few_splits(spark, n=64):
    """``n`` small Python files in one split."""
    text = F.concat(F.lit("def f"), F.col("id").cast("string"), F.lit("(a):\n" + "    a = a + 1\n" * 12 + "    return a\n"))
    return spark.range(n).select(F.concat(F.lit("src/m"), F.col("id").cast("string"), F.lit(".py")).alias("path"), text.alias("content")).coalesce(1)


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_functions_of_one_split_are_measured_in_many_tasks(spark):
    assert tasks_of(tree.functions(few_splits(spark))) > 1
    assert tasks_of(tree.line_counts(tree._sized(few_splits(spark)))) > 1


def test_clones_parse_every_file_once(spark):
    out = tree.clones(few_splits(spark))
    assert "MapInPandas" not in out._jdf.queryExecution().toString()  # parsed already, into the shared folder
    (row,) = out.collect()
    assert row.occurrences == 64 and row.other_locations.count(" | ") == 62 and row.name == "src/m0.py::f0:1"


def test_complexity_deals_its_files_and_measures_as_before(spark):
    assert "REPARTITION_BY_NUM" in tree.complexity(few_splits(spark))._jdf.queryExecution().toString()
    text = "@d(lambda: 0)\ndef f(a, *, b=(lambda x: x if x else 0)):\n    if a:\n        return 1\n    elif b:\n        return [y for y in a if y]\n    def g():\n        pass\n    return g\n"
    (f,) = (i for i in structure.items("a.py", text) if i.name == "f")
    assert (f.params, f.cyclomatic, f.cognitive, f.exits) == (3, 3, 3, 3)
    assert f.skeleton.count("(If(Name(Load))(Return") == 2 and f.skeleton.count("<fn>") == 2


def test_documentation_is_told_without_measures_and_in_many_tasks(spark, monkeypatch):
    assert "REPARTITION_BY_NUM" in tree.doc_coverage(few_splits(spark), least=1)._jdf.queryExecution().toString()
    monkeypatch.setattr(structure, "_tokens", None)
    monkeypatch.setattr(structure, "_measure", None)
    assert structure.documented("a.py", 'def f():\n    "doc"\n\n\nclass A:\n    def g(self):\n        return 1\n') == (3, 1)
    assert structure.documented("a.rs", "/// doc\npub fn f() {}\n") == (1, 1)


def test_constructs_are_listed_without_measures_and_in_many_tasks(spark, monkeypatch):
    files = few_splits(spark)
    assert tasks_of(tree.constructs(files)) > 1 and tree.constructs(files).count() == 64
    monkeypatch.setattr(structure, "_tokens", None)
    (item,) = structure.items("a.py", "def f(a):\n    return a\n", measured=False)
    assert (item.qualified, item.kind, item.start, item.end, item.params) == ("f", "function", 1, 2, 1)


def test_changes_as_planned_are_those_of_the_sql(spark, data):
    names = [*synthetic._TABLES["changes_mix"].split()]
    for t in names:
        df = spark.read.parquet(f"{data}/{t}.parquet")
        if t == "orders":  # an order that is there twice, with another priority, and one without any
            df = df.unionByName(df.limit(40).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.lit("other"))))
        df.createOrReplaceTempView(t)
    for name in ("changes_mix", "changes_basket"):
        sums, columns = synthetic.PLANS[name]
        want, got = spark.sql(synthetic.VIEWS[name]), spark.sql(sums).selectExpr(*columns)
        assert got.schema == want.schema
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_changes_of_larger_tables_are_dealt_over_more_tasks(spark, data, monkeypatch):
    few = synthetic.view(spark, data, "changes_mix")
    want = few.collect()
    monkeypatch.setattr(synthetic, "TASK_BYTES", 1 << 12)
    many = synthetic.view(spark, data, "changes_mix")
    assert tasks_of(many) > 2 * tasks_of(few) and sorted(map(str, many.collect())) == sorted(map(str, want))


def test_reports_over_constructs_build_the_changes_once(spark, data):
    for name in ("hotspots", "construct_churn", "construct_ownership"):
        assert "lineitem" not in catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_ancestors_hold_no_lists_and_find_all(spark, monkeypatch):
    kept = []
    for name in ("cut", "stage"):
        plain = getattr(cluster, name)
        monkeypatch.setattr(cluster, name, lambda df, plain=plain: kept.append(df.dtypes) or plain(df))
    # two chains of 100 and 70 commits that meet in a merge over a third of 30
    rows = [(k, k + 1) for k in range(99)] + [(99, 300)] + [(k, k + 1) for k in range(100, 169)] + [(169, 300), (300, 400), (300, 301)] + [(k, k + 1) for k in range(301, 330)] + [(500, 501)]
    got = tree.ancestors(spark.createDataFrame(rows, "oid long, parent long"), spark.createDataFrame([(0,), (100,)], "oid long"))
    assert sorted(r.oid for r in got.collect()) == [*range(170), *range(300, 331), 400]
    assert not any(kind.startswith("array") for types in kept for _, kind in types)


def test_health_deals_its_files_over_tasks(spark, data):
    reports = catalog._reports(spark, data)
    for name in ("complexity", "large_sources", "debt_markers", "composition", "fan_in_out"):
        assert "REPARTITION_BY_NUM" in reports[name]._jdf.queryExecution().toString(), name
    assert not synthetic._held
