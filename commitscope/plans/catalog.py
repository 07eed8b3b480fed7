"""Every report as a query over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.cluster import ship
from commitscope.functions import paths as P
from commitscope.plans import history, oracle, oracle_tree, tree
from commitscope.scoring.health import findings, findings_sql, health, health_sql
from commitscope.sources.synthetic import shared_views, view

AS_OF = oracle.AS_OF
Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, report: Callable, **options) -> Query:
    return lambda spark, sf_dir: report(view(spark, sf_dir, name), **options)


def _with_constructs(report: Callable) -> Query:
    """Changes are read both as such and below the constructs, so they are built once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with shared_views(spark, sf_dir, ["changes_mix"]):
            return report(view(spark, sf_dir, "changes_mix"), view(spark, sf_dir, "constructs"))

    return run


def _filtered(**options) -> Query:
    return lambda spark, sf_dir: history.time_range(view(spark, sf_dir, "changes_mix"), **options).select("commit_oid", "file_path", "additions", "deletions")


def _source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "changes_mix").select("file_path", P.is_source().alias("is_source"), P.module_of().alias("module")).distinct()


def _ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = view(spark, sf_dir, "edges")
    return tree.ancestors(edges, edges.filter("oid % 50 = 49").select("oid"))


QUERIES: dict[str, Query] = {
    "authors": _on("changes_mix", history.authors),
    "hotspots": _with_constructs(history.hotspots),
    "churn": _on("changes_mix", history.churn),
    "ownership": _on("changes_mix", history.ownership),
    "coupling": _on("changes_basket", history.coupling),
    "module_coupling": _on("changes_basket", history.module_coupling),
    "patterns": _on("changes_events", history.patterns),
    "age": _on("changes_mix", history.age, as_of=AS_OF),
    "outliers": _on("changes_mix", history.outliers),
    "quality": _on("changes_mix", history.quality),
    "construct_churn": _with_constructs(history.construct_churn),
    "construct_ownership": _with_constructs(history.construct_ownership),
    "succession": _on("changes_mix", history.succession, as_of=AS_OF),
    "knowledge_silos": _on("changes_mix", history.knowledge_silos, as_of=AS_OF),
    "churn_pareto": _on("changes_mix", history.churn_pareto),
    "commit_velocity": _on("changes_mix", history.commit_velocity),
    "commit_size": _on("changes_mix", history.commit_size),
    "time_range_since": _filtered(since_days=365, as_of=AS_OF),
    "time_range_between": _filtered(start="1998-01-01", end="1998-12-31"),
    "source_filter": _source_filter,
}

QUERIES |= {
    "composition": _on("head_files", tree.composition),
    "quick_composition": _on("head_files", tree.quick_composition),
    "large_sources": _on("head_files", tree.large_sources, least=10),
    "test_ratio": _on("head_files", tree.test_ratio),
    "complexity": lambda spark, sf_dir: tree.complexity(view(spark, sf_dir, "head_files")).drop("mi"),
    "clones": _on("head_files", tree.clones),
    "constructs_python": _on("head_files", tree.constructs),
    "doc_coverage": _on("head_files", tree.doc_coverage, least=1),
    "fan_in_out": _on("head_files", tree.fan_in_out),
    "dead_code": _on("head_files", tree.dead_code),
    "debt_markers": _on("head_files", tree.debt_markers),
    "half_life": lambda spark, sf_dir: tree.half_life(view(spark, sf_dir, "blame"), AS_OF, paths=tree.aged_paths(view(spark, sf_dir, "head_files"))),
    "debt_markers_blamed": lambda spark, sf_dir: tree.debt_markers(view(spark, sf_dir, "head_files"), view(spark, sf_dir, "blame"), AS_OF),
    "bloat": lambda spark, sf_dir: tree.bloat(view(spark, sf_dir, "head_files").withColumn("path", F.concat("path", F.lit(".min.css")))),
    "branches": _on("refs", tree.branches, as_of=AS_OF),
    "ancestors": _ancestors,
}


#: The reports that health is made of, over the views of one made-up repository.
HEALTH = "quality knowledge_silos succession ownership complexity outliers debt_markers_blamed large_sources bloat composition branches churn churn_pareto coupling fan_in_out module_coupling authors hotspots".split()


#: Views that several of these reports read; they are built once a query, into the checkpoint folder.
SHARED = ("changes_mix", "changes_basket", "head_files")


def _reports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    with shared_views(spark, sf_dir, SHARED):
        return {n.removesuffix("_blamed"): QUERIES[n](spark, sf_dir) for n in HEALTH}


QUERIES["health"] = lambda spark, sf_dir: health(_reports(spark, sf_dir))
QUERIES["health_findings"] = lambda spark, sf_dir: findings(_reports(spark, sf_dir))


def queries() -> dict[str, Query]:
    def shipped(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    sql = {**oracle.SQL, **oracle_tree.SQL}
    mine = {n.removesuffix("_blamed"): sql[n] for n in HEALTH}
    return {**sql, "health": health_sql(mine), "health_findings": findings_sql(mine)}
