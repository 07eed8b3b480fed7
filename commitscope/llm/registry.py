"""Queries and SQL of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from commitscope.llm import bpe, exact_dedup, html_extract, langid, line_dedup, packing, quality, sharding, simhash, url_reputation

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_html": html_extract.op2_html,
    "op3_langid": langid.op3_langid,
    "op4_sharding": sharding.op4_sharding,
    "op5_urls": url_reputation.op5_urls,
    "op6_packing": packing.op6_packing,
    "op7_exact": exact_dedup.op7_exact,
    "op8_bpe": bpe.op8_bpe,
    "op9_lines": line_dedup.op9_lines,
    "op10_quality": quality.op10_quality,
}

SQL = {"op4_sharding": sharding.SQL, "op5_urls": url_reputation.SQL, "op7_exact": exact_dedup.SQL, "op9_lines": line_dedup.SQL}
