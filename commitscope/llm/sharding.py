"""Extendible hashing: shards of bounded bytes under a directory of hash-prefix bits. DataFrame functions only.

A row's address is 60 bits of the MD5 of its id and text, so equal ids do not pile up. Bytes are summed once per
address prefix of ``fine`` bits; the sums of every shorter prefix follow from these. A bucket splits on its next bit
only while it is over the limit, so a shard's depth is the least one whose prefix holds at most ``limit`` bytes.
Prefixes that are still over the limit at ``fine`` bits are few and are refined alone, ``STEP`` bits a round. Rows that
agree in all 60 bits are copies of one row: they share an address, are told apart by a row ordinal's hash in a second
address word, and split on that in the same way until every shard fits or is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load, private, staged

ADDRESS_BITS, STEP, LIMIT = 60, 12, 4 << 20


def address(id_col: str, text_col: str) -> F.Column:
    """First 60 bits of md5(id, unit separator, text) as a long; nulls count as empty."""
    key = F.concat_ws("\u001f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int, bits: int = ADDRESS_BITS, own: tuple[str, ...] = ()) -> DataFrame:
    """``rows(addr, size)`` -> leaves ``(depth, prefix, shard_bytes, shard_rows)`` covering every row.

    ``own``: more columns of rows and leaves; rows of different values have directories of their own.

    A leaf over the limit at full depth is a single over-long row, or rows of one address.
    """
    leaves, at = None, 0
    part = rows.select(*own, "addr", "size")
    while at < bits:
        to = min(bits, at + STEP)
        fine = part.groupBy(*own, F.shiftright("addr", bits - to).alias("p")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        levels = fine.select(*own, F.explode(F.sequence(F.lit(at), F.lit(to))).alias("depth"), "p", "b", "n")
        levels = levels.withColumn("prefix", F.expr(f"shiftright(p, {to} - depth)"))
        sums = staged(levels.groupBy(*own, "depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")))
        over = sums.filter((F.col("shard_bytes") > limit) & ((F.col("shard_rows") > 1) | (F.col("depth") < at)))
        parents = over.select(*own, (F.col("depth") + 1).alias("depth"), "prefix")
        # a leaf fits and its parent does not; the topmost prefixes of a round have a parent that is known not to fit
        fits = sums.join(over.select(*own, "depth", "prefix"), [*own, "depth", "prefix"], "left_anti").withColumn("up", F.shiftright("prefix", 1))
        parents = parents.withColumnRenamed("prefix", "up")
        new = fits.filter(F.col("depth") > at).join(parents, [*own, "depth", "up"], "left_semi").select(*own, "depth", "prefix", "shard_bytes", "shard_rows")
        if at == 0:
            new = new.unionByName(fits.filter("depth = 0").select(*own, "depth", "prefix", "shard_bytes", "shard_rows"))
        last = over.filter(F.col("depth") == to)
        leaves = new if leaves is None else leaves.unionByName(new)
        if to == bits:
            return leaves.unionByName(last.select(*own, "depth", "prefix", "shard_bytes", "shard_rows"))
        if not last.take(1):
            return leaves
        part = part.withColumn("top", F.shiftright("addr", bits - to)).join(last.select(*own, F.col("prefix").alias("top")), [*own, "top"], "left_semi")
        at = to
    return leaves


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs)``, one row for every row of ``docs``.

    ``shard_id`` is the binary prefix of the leaf. ``n_bytes`` is the text's UTF-8 length (null: 0). Every shard holds
    at most ``limit`` bytes unless it is a single longer row. Copies of one row may be dealt to several shards. An
    empty table gives no rows. ``row_col`` of ``docs`` is carried as ``row``.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        address(id_col, text_col).alias("addr"),
        *([F.col(row_col).alias("row")] if row_col else []),
    ).withColumn("ordinal", F.conv(F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, 15), 16, 10).cast("long"))
    slim = staged(slim)
    first = staged(directory(slim.select("addr", F.col("n_bytes").alias("size")), limit))
    whole = first.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    found = _assign(slim, whole, "addr")
    # rows that repeat one address: split on the ordinal's bits below the full prefix
    tied = first.filter((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).select(F.col("prefix").alias("addr"))
    if tied.take(1):
        copies = staged(slim.join(tied, "addr", "left_semi"))
        copies = copies.withColumnRenamed("addr", "own")
        leaves = staged(directory(copies.select("own", F.col("ordinal").alias("addr"), F.col("n_bytes").alias("size")), limit, own=("own",)))
        split = _assign(copies, leaves, "ordinal", ("own",))
        found = found.unionByName(split)
    return found


def _assign(rows: DataFrame, leaves: DataFrame, addr: str, own: tuple[str, ...] = ()) -> DataFrame:
    """Joins each row with its leaf: one equi-join on (depth, prefix) over the depths that occur.

    With ``own``, the leaves lie below the full address of that name.
    """
    carry = ["doc_id", "n_bytes", *(c for c in rows.columns if c == "row")]
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most 61 numbers
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    if own:
        name = F.concat(F.lpad(F.bin(own[0]), ADDRESS_BITS, "0"), F.lit("+"), name)
    tagged = leaves.select(*own, "depth", "prefix", name.alias("shard_id"), "shard_bytes", F.col("shard_rows").alias("shard_docs"))
    if not depths:
        return rows.limit(0).select(*carry, F.lit("").alias("shard_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"))
    each = rows.select(*carry, *own, addr, F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth"))
    each = each.withColumn("prefix", F.expr(f"shiftright({addr}, {ADDRESS_BITS} - depth)"))
    depth = F.col("depth") + (ADDRESS_BITS if own else 0)
    return each.join(tagged, [*own, "depth", "prefix"]).select(*carry, "shard_id", depth.alias("depth"), "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes ``docs`` under ``path`` with one folder a shard; each row once, whatever its id.

    Returns the name of the folders' column: ``shard_id``, with a trailing underscore where ``docs`` has such a column.
    """
    row, name = private(docs, "shard_row"), private(docs, "shard_id")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    dealt = shard(rows, limit, id_col, text_col, row).select(F.col("row").alias(row), F.concat(F.lit("b"), "shard_id").alias(name))
    rows.join(dealt, row).drop(row).repartition(name).write.partitionBy(name).parquet(path)
    return name


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs for every document, at most 4 MiB a shard."""
    return shard(load(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS addr FROM documents),
levels AS (SELECT depth, addr >> (60 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
    FROM d, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS depth) GROUP BY ALL),
leaf AS (SELECT a.* FROM levels a LEFT JOIN levels b ON b.depth = a.depth - 1 AND b.prefix = a.prefix >> 1
    WHERE (a.shard_bytes <= {LIMIT} OR a.shard_docs = 1) AND (a.depth = 0 OR b.shard_bytes > {LIMIT} AND b.shard_docs > 1))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth) END AS shard_id,
    depth, shard_bytes, shard_docs FROM d JOIN leaf ON leaf.prefix = d.addr >> (60 - leaf.depth)
"""
