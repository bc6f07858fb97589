"""Connected components of an edge table, by large-star and small-star rounds; and groups cut into pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _round(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # Joined on another expression than it was summed up by: both sides then have an exchange of their own,
    # and the rows of a hub can be split.
    joined = pairs.withColumn("k", F.bitwise_not("u")).join(least.select(F.bitwise_not("u").alias("k"), "m"), "k")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b bigint): label is the least node of its component.

    Edges may repeat, and may lead from a node to itself; such a node alone is left out, as are nulls.
    Each round is written to the shared folder. The driver sees a count and a checksum of a round only.
    """
    edges, before = written(edges.filter("a is not null and b is not null and a != b").select("a", "b").distinct(), "edges"), None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == seen or not seen.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = seen
        edges = written(_round(_round(edges, True), False), "edges")


#: Members of a block: the most, and the least where a group is large enough to be cut at all. Bytes of a block at most.
BLOCK, LEAST_BLOCK, BLOCK_BYTES = 1024, 128, 32 << 20


def block_pairs(members: DataFrame, most: int = BLOCK, size: int = BLOCK_BYTES, least: int = LEAST_BLOCK) -> DataFrame:
    """(node, label, block, i, j) for members (node, label, bytes): the pairs of blocks, i <= j, that hold a member's own.

    Every two members of a label meet at one pair (i, j): that of their blocks. A label is cut by a hash
    of its members, into blocks of four times the root of their number, within bounds: so a member is
    moved a few times where a group is of middling size, and large groups don't become one task.
    """
    sizes = written(members.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_bytes")), "group-sizes")
    each = F.greatest(F.lit(min(least, most)), F.least(F.lit(most), 4 * F.sqrt("_n")))
    n = F.ceil(F.greatest(F.col("_n") / each, F.col("_bytes") / size, F.lit(1.0))).cast("bigint")
    own = members.join(sizes, "label").select("node", "label", n.alias("_blocks"), F.pmod(F.xxhash64("node"), n).alias("block"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    return own.select("node", "label", "block", F.explode(pairs).alias("_p")).select("node", "label", "block", "_p.i", "_p.j")
