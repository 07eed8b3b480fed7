"""Exact de-duplication by content-defined chunk recipes. DataFrame functions only.

A text without white space is cut after content-defined marks (a pair of characters from fixed classes) into chunks of
``LEAST`` to ``MOST`` characters, so equal passages give equal chunks wherever they stand. One pass over the texts names
each chunk by a 64-bit identifier and a 128-bit check. Chunks are deduplicated by content: identifiers are counted with
map-side combination, and one that stands for chunks of different checks is not verified; it is then replaced in the
recipes by the check. A document is its recipe, the ordered list of verified identifiers (8 bytes for some hundred
characters); only recipes are compared and moved, and every row finds its group by its recipe. Texts never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load, staged

LEAST, MOST = 256, 4096
#: Shortest cut of at least LEAST characters that ends in a mark, at most MOST characters.
CHUNK = f"(?s).{{{LEAST},{MOST - 2}}}?[b-dg-hm-n\\u00e0-\\u00ef\\u4e00-\\u5fff][aeo\\u00f0-\\u00ff\\u6000-\\u7fff]|.{{1,{MOST}}}"


def squeezed(text: str) -> F.Column:
    """The text without characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        out = F.replace(out, F.lit(c))
    return out


def _identifier(chunk: F.Column) -> F.Column:
    return F.xxhash64(chunk)


def _check(chunk: F.Column) -> F.Column:
    return F.unhex(F.md5(chunk.cast("binary")))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_points, text_sha256, ids, checks)``: recipe ``ids``; ``checks`` is not null where an identifier was not verified."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = slim.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_points"), squeezed("text").alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    named = F.transform(cut, lambda c: F.struct(_identifier(c).alias("id"), _check(c).alias("check")))
    made = staged(slim.select("doc_id", "n_points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), named.alias("chunks")))
    each = made.select(F.explode("chunks").alias("c")).select("c.id", "c.check")
    spread = each.groupBy("id").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    clash = staged(spread.filter("low <> high").select("id"))
    ids = F.col("chunks.id").alias("ids")
    if not clash.take(1):
        return made.select("doc_id", "n_points", "text_sha256", ids, F.lit(None).cast("array<binary>").alias("checks"))
    # a recipe with an identifier that is not verified is told apart by the checks of its chunks as well
    unsure = made.select("text_sha256", F.explode("chunks.id").alias("id")).join(clash, "id", "left_semi").select("text_sha256").distinct()
    marked = made.join(unsure.withColumn("unsure", F.lit(True)), "text_sha256", "left")
    return staged(marked.select("doc_id", "n_points", "text_sha256", ids, F.when(F.col("unsure"), F.col("chunks.check")).alias("checks")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for every row of ``docs``.

    Of equal texts the row with the most code points stays, then the one with the least doc_id (null ids last). Null
    and blank texts are equal to the empty text. Rows that repeat the kept id are all marked kept: they are one
    document. An empty table gives no rows.
    """
    made = recipes(docs, id_col, text_col)
    order = F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("low"))
    # counted per task first, so a group of any size is a few rows
    group = made.groupBy("ids", "checks").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # staged: the join then has plain shuffles on both sides, and rows of one recipe can be split by AQE
    group = staged(group.select("ids", "checks", (-F.col("best.low")).alias("keep_id"), F.col("best.n_points").alias("keep_points"), "group_size"))
    rows = made.alias("r").join(group.alias("g"), (F.col("r.ids") == F.col("g.ids")) & F.col("r.checks").eqNullSafe(F.col("g.checks")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    return exact_groups(load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (norm)
"""
