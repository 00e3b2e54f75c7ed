"""Byte-balanced shards by extendible hashing.

A shard is a prefix of the documents' hash bits. The directory starts with one bucket, and only a
bucket over the byte limit splits on one more bit, until each fits or holds a single document. The whole directory comes from
one histogram: bytes by cell, a prefix a few bits longer than shards need on average, summed up to
every shorter prefix; a cell's shard is its shortest prefix within the limit. Cells that alone are
over the limit get the next bits in another round, so the number of rounds doesn't hang on the data's
size. The directory is a table; documents meet it in a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.numbering import dense_position
from logweave.operators.pinning import pin

HASH_BITS = 60
#: Bytes of text in a shard, what one reader holds at once: by default, and in the registered query, whose tables are small.
LIMIT, QUERY_LIMIT = 256 << 20, 256 << 10
_STEP = 8


def _prefix(bits: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, (F.lit(HASH_BITS) - depth).cast("int"))


def _leaves(rows: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes): for each cell of `depth` bits its shortest prefix, of more than `above` bits, within the limit or of one row; depth null if none is."""
    cells = pin(rows.groupBy(_prefix(F.col("bits"), depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
    ups = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth")).withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("depth")).cast("int")))
    fit = pin(ups.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n")).where((F.col("shard_bytes") <= limit) | (F.col("n") == 1)).drop("n"))
    found = ups.join(fit, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
    return pin(cells.select("cell").join(found, "cell", "left").select("cell", "leaf.*"))


def shard_documents(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` (the id, by default) and n_bytes, shard (its bits; 'root' if it never split), depth, page, shard_bytes for every row.

    No shard has more than `limit` bytes of text, except one that holds a single larger document, however long.
    A null text has 0 bytes. The hash is of id and text, so only rows that repeat with both can't be
    told apart by bits; those of an oversized bucket go to pages that fit, numbered from 0. An empty
    table gives an empty result.
    """
    carry = carry or [id_col]
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    keys = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    rows = pin(docs.select(*keys, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("bits")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    above, depth, rest, done = 0, min(HASH_BITS, math.ceil(math.log2(max(1, total / limit))) + _STEP // 2), rows, []
    while True:
        leaves = _leaves(rest, above, depth, limit)
        placed = rest.join(leaves, _prefix(rest["bits"], depth) == leaves["cell"]).drop("cell")
        done.append(placed.where("depth is not null").withColumn("page", F.lit(0).cast("long")))
        if not leaves.where("depth is null").limit(1).count():
            break
        rest = pin(placed.where("depth is null").drop("depth", "prefix", "shard_bytes"))
        if depth == HASH_BITS:
            done.append(_pages(rest, limit))
            break
        above, depth = depth + 1, min(HASH_BITS, depth + _STEP)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, "root").otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0")))
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "n_bytes", bits.alias("shard"), F.col("depth").cast("long").alias("depth"), "page", "shard_bytes")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that share all bits, so repeat, and so are equally long: as many to a page as fit, at least one."""
    ordered = pin(dense_position(rows, ["bits", F.rand(1)], "__at"))
    start = ordered.groupBy("bits").agg(F.min("__at").alias("__start"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1)))).cast("long")
    paged = pin(ordered.join(pin(start), "bits").withColumn("page", F.floor((F.col("__at") - F.col("__start")) / each).cast("long")).drop("__at", "__start"))
    sums = pin(paged.groupBy("bits", "page").agg(F.sum("n_bytes").alias("shard_bytes")))
    return paged.join(sums, ["bits", "page"]).withColumn("depth", F.lit(HASH_BITS)).withColumn("prefix", F.col("bits"))
