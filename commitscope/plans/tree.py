"""Reports over the files of a tree, ``head_files(path, content)``, and over its branches.

Files are spread over tasks by path; Python runs only for the line classifier and the structural parsers, a row out
for each file or construct. Everything after that is native.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitscope import cluster
from commitscope.functions import paths as P
from commitscope.functions.languages import by_extension, by_name, detect, languages
from commitscope.functions.lines import classify, count
from commitscope.operators import structure

MB = 1 << 20


def _sized(files: DataFrame) -> DataFrame:
    """``(path, content, bytes, binary)``: sizes and binary marks of the source where it gives them, else of the text.

    A source of blobs gives ``size`` and ``binary`` (a NUL byte early on, or no UTF-8) and no content for binary files.
    """
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    binary = F.col("binary") if "binary" in files.columns else F.instr(F.left("content", F.lit(8192)), "\0") > 0
    return files.select("path", F.coalesce("content", F.lit("")).alias("content"), size.cast("long").alias("bytes"), F.coalesce(binary, F.lit(False)).alias("binary"))


def _files(files: DataFrame, most: int) -> DataFrame:
    return _sized(files).filter((F.col("bytes") > 0) & (F.col("bytes") <= most))


def _texts(files: DataFrame, most: int) -> DataFrame:
    return _files(files, most).filter("not binary")


def _spread(files: DataFrame) -> DataFrame:
    """``files`` dealt over tasks by path: a table of a few large splits would leave all parsing to as many tasks."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return files.repartition(parts, "path")


def line_counts(files: DataFrame) -> DataFrame:
    """``(path, bytes, language, code, comment, blank, total)`` of ``_files``; language null if unknown, marked if binary."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, size, binary in zip(part["path"], part["content"], part["bytes"], part["binary"], strict=True):
                lang = None if binary else detect(path, text)
                c = {"code": 0, "comment": 0, "blank": 0} if binary or lang is None else count(text, lang)
                rows.append((path, 0 if binary else size, "(binary/skipped)" if binary else lang, c["code"], c["comment"], c["blank"]))
            yield pd.DataFrame(rows, columns=["path", "bytes", "language", "code", "comment", "blank"])

    out = _spread(files).mapInPandas(run, "path string, bytes long, language string, code long, comment long, blank long")
    return out.withColumn("total", F.col("code") + F.col("comment") + F.col("blank"))


def composition(files: DataFrame) -> DataFrame:
    """Lines by language; files over 2 MiB or of no known language count as (unknown)."""
    small = line_counts(_files(files, 2 * MB))
    large = _sized(files).select("path", "bytes").filter(F.col("bytes") > 2 * MB)
    large = large.select("path", "bytes", F.lit(None).cast("string").alias("language"), *[F.lit(0).cast("long").alias(c) for c in ("code", "comment", "blank", "total")])
    per = small.unionByName(large).groupBy(F.coalesce("language", F.lit("(unknown)")).alias("name")).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank", "total", "bytes")])
    total = per.agg(F.sum("code").alias("all_code"))
    pct = lambda a, b: F.when(b > 0, F.round(F.lit(100.0) * a / b, 1)).otherwise(F.lit(0.0))
    out = per.crossJoin(F.broadcast(total))  # one row
    return out.select(
        "name", "files", "code", "comment", "blank", F.col("total").alias("total_lines"), pct(F.col("code"), F.col("all_code")).alias("code_pct"), pct(F.col("comment"), F.col("code") + F.col("comment")).alias("comment_ratio_pct"), "bytes"
    ).orderBy(F.desc("code"), "name")


def quick_composition(files: DataFrame) -> DataFrame:
    per = line_counts(_texts(files.filter(P.is_source("path")), 2 * MB)).filter("language is not null and code > 0").groupBy("language").agg(F.sum("code").alias("code_lines"), F.count(F.lit(1)).alias("files"))
    total = per.agg(F.sum("code_lines").alias("n"))
    return per.crossJoin(F.broadcast(total)).select("language", F.round(F.lit(100.0) * F.col("code_lines") / F.col("n"), 2).alias("percentage"), "code_lines", "files").orderBy(F.desc("percentage"), "language")


LARGE_LANGUAGES = "Bash C C# C++ Dart Go Java JavaScript Kotlin Lua Objective-C PHP Python Ruby Rust Scala Swift TypeScript".split()


def large_sources(files: DataFrame, least: int = 500, cap: int = 100) -> DataFrame:
    rows = line_counts(_texts(files, 20 * MB)).filter(F.col("language").isin(*LARGE_LANGUAGES) & (F.col("code") >= least))
    advice = F.when(F.col("code") >= 5000, "enormous").when(F.col("code") >= 1500, "very_large").otherwise("sizeable")
    return rows.select(
        F.col("path").alias("name"), F.col("bytes").alias("size_bytes"), P.source_size("bytes").alias("size_human"), F.col("code").alias("code_lines"), F.col("comment").alias("comment_lines"), F.col("blank").alias("blank_lines"),
        F.col("total").alias("total_lines"), "language", advice.alias("recommendation"),
    ).orderBy(F.desc("code_lines"), "name").limit(cap)


def test_ratio(files: DataFrame) -> DataFrame:
    rows = line_counts(_texts(files.filter(P.is_source("path")), 2 * MB)).filter("language is not null").withColumn("test", P.is_test_file().cast("int"))
    per = rows.rollup("language").agg(
        F.count_if(F.col("test") == 0).alias("source_files"), F.count_if(F.col("test") == 1).alias("test_files"),
        F.coalesce(F.sum(F.when(F.col("test") == 0, F.col("code"))), F.lit(0)).alias("source_lines"), F.coalesce(F.sum(F.when(F.col("test") == 1, F.col("code"))), F.lit(0)).alias("test_lines"),
    )
    whole = F.col("source_lines") + F.col("test_lines")
    return per.select(F.coalesce("language", F.lit("(total)")).alias("name"), "source_files", "test_files", "source_lines", "test_lines", F.when(whole > 0, F.floor(F.lit(100) * F.col("test_lines") / whole)).otherwise(0).cast("long").alias("test_pct"))


SOURCE_EXT = "bash c cc cpp cs cxx dart go h hpp java js jsx kt kts lua m mjs mm php pl py rb rs scala sh sql swift ts tsx".split()
BLOAT = (
    (".min.js", "minified_bundle"), (".min.css", "minified_bundle"), ("node_modules/", "vendored_deps"), ("dist/", "build_output"), ("build/", "build_output"), ("target/", "rust_build_output"),
    ("vendor/", "vendored_deps"), (".DS_Store", "os_metadata"), (".idea/", "ide_config"), (".vscode/", "ide_config"),
)


def bloat(files: DataFrame, top: int = 30) -> DataFrame:
    """The largest files that are no source, and all suspicious ones."""
    rows = _sized(files).select(F.col("path").alias("name"), F.col("bytes").alias("size_bytes"))
    rows = rows.filter(~(P.extension(F.col("name")).isin(*SOURCE_EXT) & (F.col("size_bytes") < 20 * MB)))
    advice = F.when(F.col("size_bytes") >= 5 * MB, "very_large_file").when(F.col("size_bytes") >= 500 << 10, "large_file").otherwise("ok")
    for pattern, code in reversed(BLOAT):
        advice = F.when(F.col("name").contains(pattern), code).otherwise(advice)
    rows = rows.withColumn("recommendation", advice)
    largest = rows.orderBy(F.desc("size_bytes"), "name").limit(top).filter("recommendation <> 'ok'")
    out = largest.unionByName(rows.filter("recommendation not in ('ok', 'large_file')")).distinct()
    return out.select("name", "size_bytes", P.human_size("size_bytes").alias("size_human"), "recommendation")


_FUNCTION = "path string, function string, line long, size long, cyclomatic long, cognitive long, mi long, lines long, args long, exits long, language string, shape string"


def functions(files: DataFrame, most: int = 512 << 10) -> DataFrame:
    """Measures of every function, one row each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in _FUNCTION.split(", ")]
        for part in parts:
            yield pd.DataFrame([f for p, t in zip(part["path"], part["content"], strict=True) for f in structure.functions(p, t)], columns=columns)

    known = F.lower(P.extension(F.col("path"))).isin(*structure.EXT)
    return _spread(_texts(files, most).filter(known)).mapInPandas(run, _FUNCTION)


def complexity(files: DataFrame, cap: int = 200) -> DataFrame:
    advice = F.when(F.col("cyclomatic") <= 5, "simple").when(F.col("cyclomatic") <= 10, "ok").when(F.col("cyclomatic") <= 20, "high").otherwise("very_high")
    name = F.concat("path", F.lit("::"), "function", F.lit(":"), F.col("line").cast("string"))
    rows = functions(files).select(name.alias("name"), "cyclomatic", "cognitive", "mi", "lines", "args", "exits", "language", advice.alias("recommendation"))
    return rows.orderBy(F.desc("cyclomatic"), "name").limit(cap)


def clones(files: DataFrame, least: int = 10, cap: int = 100) -> DataFrame:
    """Groups of functions with one shape. Groups are ranked on counts; only the reported groups gather their places.

    Files are parsed once: the long functions are written to the shared folder, and both steps read them there.
    """
    rows = cluster.stage(functions(files.filter(P.is_source("path"))).filter(F.col("size") >= least).select("path", "function", "line", "size", "shape"))
    first = F.min(F.struct("path", "line", "function", "size"))
    groups = rows.groupBy("shape").agg(F.count(F.lit(1)).alias("occurrences"), first.alias("f")).filter("occurrences > 1")
    top = groups.withColumn("payoff", F.col("f.size") * (F.col("occurrences") - 1)).orderBy(F.desc("payoff"), "f.path", "f.line").limit(cap)
    place = lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string"))
    members = rows.join(F.broadcast(top.select("shape")), "shape", "left_semi").groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("all"))
    joined = top.join(members, "shape")
    return joined.select(
        F.concat("f.path", F.lit("::"), "f.function", F.lit(":"), F.col("f.line").cast("string")).alias("name"), "occurrences", F.col("f.size").alias("size_lines"),
        F.array_join(F.transform(F.slice("all", 2, 1 << 30), place), " | ").alias("other_locations"),
    ).orderBy(F.desc(F.col("size_lines") * (F.col("occurrences") - 1)), "name")


def doc_coverage(files: DataFrame, least: int = 3, cap: int = 200) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, *structure.documented(p, t), structure.language(p)) for p, t in zip(part["path"], part["content"], strict=True)], columns=["path", "public_items", "documented", "language"])

    known = F.lower(P.extension(F.col("path"))).isin(*[e for e, n in structure.EXT.items() if n in structure.METRIC])
    rows = _spread(_texts(files, 512 << 10).filter(known & P.is_source("path"))).mapInPandas(run, "path string, public_items long, documented long, language string").filter(F.col("public_items") >= least)
    pct = F.round(F.lit(100.0) * F.col("documented") / F.col("public_items")).cast("long")
    advice = F.when(pct <= 24, "poor").when(pct <= 59, "low").when(pct <= 84, "ok").otherwise("good")
    return rows.select(F.col("path").alias("name"), "public_items", "documented", pct.alias("coverage_pct"), "language", advice.alias("recommendation")).orderBy("coverage_pct", F.desc("public_items"), "name").limit(cap)


def constructs(files: DataFrame) -> DataFrame:
    """Every construct of every file: path, qualified_name, kind, start_line, end_line."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, i.qualified, i.kind, i.start, i.end) for p, t in zip(part["path"], part["content"], strict=True) for i in structure.items(p, t, measured=False)], columns=["path", "qualified_name", "kind", "start_line", "end_line"])

    return _spread(_texts(files, 512 << 10)).mapInPandas(run, "path string, qualified_name string, kind string, start_line long, end_line long")


_IMPORT_PY = r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))"
_IMPORT_JS = r"(?:from|require\()\s*['\"]([^'\"]+)['\"]"
_IMPORT_RS = r"(?m)^[ \t]*(?:pub\s+)?(?:use\s+((?:crate|self|super)(?:::\w+)+)|mod\s+(\w+)\s*;)"
IMPORTERS = ("rs", "py", "ts", "tsx", "js", "jsx")


def _normal(path: Column) -> Column:
    """``a/./b/../c`` -> ``a/c``."""
    parts = F.split(path, "/")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(folded, "/")


def imports(files: DataFrame) -> DataFrame:
    """``(source, target)``: one row an import statement that resolves to another file of the tree.

    Candidates of a statement are probed in order; the first that exists wins.
    """
    ext = P.extension(F.col("path"))
    rows = _spread(_texts(files, 200 << 10).filter(ext.isin(*IMPORTERS) & P.is_source("path"))).select("path", "content", ext.alias("ext"))

    def either(pattern: str) -> Column:
        """The one of two groups that each match filled."""
        both = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(k)).alias(c) for k, c in ((1, "a"), (2, "b"))])
        return F.transform(both, lambda m: F.concat(m["a"], m["b"]))

    py, rs, js = either(_IMPORT_PY), either(_IMPORT_RS), F.regexp_extract_all("content", F.lit(_IMPORT_JS), F.lit(1))
    each = rows.select("path", "ext", F.posexplode(F.when(F.col("ext") == "py", py).when(F.col("ext") == "rs", rs).otherwise(js)).alias("nth", "what"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    beside = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    mod = F.replace(F.regexp_replace("what", r"^\.+", ""), F.lit("."), F.lit("/"))
    python = F.array(*[F.concat(F.lit(x), mod, F.lit(y)) for x in ("", "src/") for y in (".py", "/__init__.py")])
    base = _normal(F.concat(folder, F.lit("/"), F.col("what")))
    script = F.when(F.col("what").startswith("."), F.array(*[F.concat(base, F.lit(x)) for x in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "")])).otherwise(F.array().cast("array<string>"))
    tail = F.slice(F.split("what", "::"), 2, 1 << 30)
    # paths from the crate's root, the longest prefix first; a declared module is a sibling
    cut = lambda n: F.concat(F.lit("src/"), F.array_join(F.slice(tail, F.lit(1), n), "/"))
    lengths = F.sequence(F.size(tail), F.lit(1))
    rust = F.flatten(F.transform(F.when(F.size(tail) > 0, lengths).otherwise(F.array().cast("array<int>")), lambda n: F.array(F.concat(cut(n), F.lit(".rs")), F.concat(cut(n), F.lit("/mod.rs")))))
    rust = F.when(F.col("what").contains("::"), rust).otherwise(F.array(F.concat(beside, "what", F.lit(".rs")), F.concat(beside, "what", F.lit("/mod.rs"))))
    tried = each.select("path", "nth", F.posexplode(F.when(F.col("ext") == "py", python).when(F.col("ext") == "rs", rust).otherwise(script)).alias("pos", "target"))
    there = files.select(F.col("path").alias("target")).distinct()
    hit = tried.join(there, "target").groupBy("path", "nth").agg(F.min_by("target", "pos").alias("target"))
    return hit.select(F.col("path").alias("source"), "target").filter("source <> target")


def fan_in_out(files: DataFrame, cap: int = 150) -> DataFrame:
    edges = imports(files)
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    per = ends.groupBy("e.name").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    i, o = F.col("fan_in"), F.col("fan_out")
    role = F.when((i >= 5) & (o <= 2), "hub").when((o >= 5) & (i <= 1), "orchestrator").when(i == 0, "leaf").when(o == 0, "pure_dep").otherwise("mixed")
    return per.select("name", "fan_in", "fan_out", F.floor(F.lit(100) * o / (i + o)).cast("long").alias("instability_pct"), role.alias("role")).orderBy(F.desc("fan_in"), "name").limit(cap)


def dead_code(files: DataFrame, cap: int = 200) -> DataFrame:
    path = F.col("path")
    test = F.concat(F.lit("/"), path).rlike(P.ORPHAN_TEST_DIR) | path.rlike(P.ORPHAN_TEST_NAME)
    seen = files.filter(P.is_source("path") & P.extension(path).isin("rs", "py", "ts", "tsx", "js", "jsx") & ~P.basename(path).isin(*P.ENTRY_POINTS) & ~test).select("path")
    used = imports(files).select(F.col("target").alias("path"))
    return seen.join(used, "path", "left_anti").select(F.col("path").alias("name"), P.extension(path).alias("extension")).orderBy("name").limit(cap)


_MARKED = r"(?i)\b(TODO|FIXME|HACK|XXX)\b"
MARKER = re.compile(_MARKED + r"(?:\(([^)]+)\))?\s*[:\-]?\s*(.*)")
#: Files whose lines are blamed: those with the most markers.
BLAMED_FILES = 150


def markers(files: DataFrame) -> DataFrame:
    """``(path, line, marker, owner, text)``: markers on comment lines, or behind a comment token of the language."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                if (lang := languages().get(detect(path, content) or "")) is None:
                    continue
                tokens = [*lang.line, *(a for a, _ in lang.block)]
                for k, (line, kind) in enumerate(zip(content.split("\n"), classify(content, lang.name), strict=False), 1):
                    if (m := MARKER.search(line)) and (kind == "comment" or any(t in line[: m.start()] for t in tokens)):
                        rows.append((path, k, m[1].upper(), m[2] or "", P.snippet(m[3].strip())))
            yield pd.DataFrame(rows, columns=["path", "line", "marker", "owner", "text"])

    return _spread(_texts(files, 500 << 10).filter(F.col("content").rlike(_MARKED))).mapInPandas(run, "path string, line long, marker string, owner string, text string")


def debt_markers(files: DataFrame, blame: DataFrame | Callable[[DataFrame], DataFrame] | None = None, as_of: str | None = None, cap: int = 200) -> DataFrame:
    """Markers with the age and author of their lines.

    ``blame(path, line_start, len, author, commit_ts)``, or a function that blames the paths it is given: the source
    files among the ``BLAMED_FILES`` with the most markers.
    """
    rows = markers(files)
    unknown = {"author": F.lit("<not-blamed>"), "age_days": F.lit(-1).cast("long")}
    if blame is None:
        rows = rows.withColumns(unknown)
    else:
        if callable(blame):
            rows = rows.cache()
            most = rows.groupBy("path").count().orderBy(F.desc("count"), "path").limit(BLAMED_FILES).filter(P.is_source("path"))
            blame = blame(most.select("path"))
        spans = blame.select(F.col("path").alias("p"), "author", "commit_ts", "line_start", F.col("len").alias("n"))
        # a line meets the spans of its own file alone; spans are not taken apart
        on = (F.col("path") == F.col("p")) & (F.col("line") >= F.col("line_start")) & (F.col("line") < F.col("line_start") + F.col("n"))
        rows = rows.join(spans, on, "left")
        rows = rows.withColumns({"author": F.coalesce("author", F.lit("<not-blamed>")), "age_days": F.coalesce(F.datediff(F.lit(as_of), "commit_ts").cast("long"), F.lit(-1).cast("long"))})
    a = F.col("age_days")
    band = F.when(a < 0, "age_unknown").when(a < 30, "fresh").when(a < 180, "aging").when(a < 365, "stale").otherwise("rotten")
    name = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    return rows.select(name.alias("name"), "marker", "age_days", "author", "owner", "text", band.alias("recommendation")).orderBy(F.desc("age_days"), "name").limit(cap)


def aged_paths(files: DataFrame, cap: int = 50) -> DataFrame:
    """``path`` of the files whose lines get an age: source files among the first ``cap`` small ones of known extensions."""
    small = _sized(files).filter((F.col("bytes") <= P.AGED_BYTES) & P.extension(F.col("path")).isin(*P.AGED_EXT))
    return small.select("path").orderBy("path").limit(cap).filter(P.is_source("path"))


def half_life(blame: DataFrame, as_of: str, ancient_days: int = 180, paths: DataFrame | None = None) -> DataFrame:
    """Share of lines at least ``ancient_days`` old in each blamed file, or in those of ``paths`` (see ``aged_paths``)."""
    rows = blame if paths is None else blame.join(F.broadcast(paths), "path", "left_semi")  # at most 50 paths
    days = F.datediff(F.lit(as_of), "commit_ts")
    per = rows.groupBy("path").agg(F.sum("len").alias("total_lines"), F.sum(F.when(days >= ancient_days, F.col("len")).otherwise(0)).alias("ancient_lines"), F.max(days).cast("long").alias("oldest_age_days"))
    pct = F.floor(F.lit(100) * F.col("ancient_lines") / F.col("total_lines")).cast("long")
    band = F.when(pct <= 20, "hot").when(pct <= 50, "aging").when(pct <= 80, "stable").otherwise("core")
    return per.filter("total_lines > 0").select(F.col("path").alias("name"), "total_lines", "ancient_lines", pct.alias("ancient_pct"), "oldest_age_days", band.alias("recommendation")).orderBy("ancient_pct", "name")


def branches(refs: DataFrame, as_of: str) -> DataFrame:
    """``refs(name, last_commit, author, merged, is_head)`` with days since and status."""
    days = F.greatest(F.datediff(F.lit(as_of), "last_commit"), F.lit(0)).cast("long")
    d = F.col("days_since")
    status = F.when(F.col("is_head") == "yes", "head").when((F.col("merged") == "yes") & (d >= 60), "merged_stale").when(F.col("merged") == "yes", "merged_recent").when(d >= 180, "abandoned").when(d >= 60, "stale").otherwise("active")
    return refs.withColumn("days_since", days).select(status.alias("group"), "name", "last_commit", "days_since", "author", "merged", "is_head", status.alias("recommendation"))


def ancestors(edges: DataFrame, head: DataFrame, most: int = 10_000, reach: int = 64) -> DataFrame:
    """``oid`` of all ancestors of ``head(oid)`` over ``edges(oid, parent)``, heads included.

    A frontier of newly reached commits advances; the edge table never grows, whatever merges it has. Where a chain has
    one parent a commit, up to ``reach`` steps are taken in one round: a commit has a pointer for every power of two, and
    the frontier follows the longest first, so that a commit holds a few numbers and no list of those before it.
    Rounds cut their lineage in the checkpoint folder; only row counts reach the driver.
    """
    cut = cluster.cut
    edges = cluster.stage(edges.select("oid", "parent").distinct())
    single = edges.groupBy("oid").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")).filter("n = 1").select("oid", "parent")
    # pointers 1, 2, 4 ... single steps on, or to the end of the chain
    jumps = [cluster.stage(single.select("oid", F.col("parent").alias("last")))]
    for _ in range(max(0, reach.bit_length() - 2)):
        on = jumps[-1].select(F.col("oid").alias("last"), F.col("last").alias("then"))
        jumps.append(cluster.stage(jumps[-1].join(on, "last", "left").select("oid", F.coalesce("then", "last").alias("last"))))
    front, seen = cut(head.select("oid").distinct()), None
    for _ in range(most):
        found = front
        for jump in reversed(jumps):
            found = found.join(jump, "oid", "left").select(F.explode(F.array("oid", F.coalesce("last", "oid"))).alias("oid")).distinct()
        found = cut(found if seen is None else found.join(seen, "oid", "left_anti"))
        seen = found if seen is None else cut(seen.unionByName(found))
        # only parents that nobody has reached go on
        front = cut(found.join(edges, "oid").select(F.col("parent").alias("oid")).distinct().join(seen, "oid", "left_anti"))
        if not front.take(1):
            return seen
    raise ValueError("the history is deeper than the round limit allows")


def known_languages() -> list[str]:
    return sorted({*by_extension().values(), *by_name().values()})
