"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where a short window of its own bytes meets a rule, so equal texts get equal
chunks. Each chunk is named by a 64-bit hash, and a document by the ordered list of those names. One
shuffle of the distinct chunks verifies that no name stands for two contents; if one does, the chunks
under that name are told apart by content. Only names move after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, numbered_columns, table, without, written

MIN_CHUNK, MAX_CHUNK = 512, 4096


def cut_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK, ascii: bool = False) -> str:
    """A chunk ends after three bytes that are 1, 4 and 0 modulo 8, or at `most`.

    Unless all is ASCII it also ends after three characters of several bytes, with one other between at
    most, whose last bytes are so: in some scripts no neighbouring bytes can be.
    """
    of = lambda r, low=0x20: "[" + "".join(f"\\u{c:04x}" for c in range(low, 0xC0 if low > 0x20 else 0x100) if c % 8 == r) + "]"
    start = "[\\u0000-\\u007f]?[\\u00c2-\\u00f4][\\u0080-\\u00bf]{0,2}"
    # The last byte is looked at alone first: in most places it settles the matter.
    rules = [f"(?<={of(1)}{of(4)}{of(0)})"] + ([] if ascii else [f"(?<={of(0, 0x80)})(?<={start.join([of(1, 0x80), of(4, 0x80), of(0, 0x80)])})"])
    return f"(?s).{{{least},{most}}}?(?:{'|'.join(rules)})|.{{1,{most}}}"


def chunks(text, least: int = MIN_CHUNK, most: int = MAX_CHUNK):
    """Array of the chunks (binary) of a text column's UTF-8; concatenated they are the text.

    The pattern sees a character for each byte, so that the rule cuts text of any script.
    """
    plain = F.regexp_extract_all(text, F.lit(cut_pattern(least, most, ascii=True)), F.lit(0))
    other = F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(cut_pattern(least, most)), F.lit(0))
    found = F.when(F.length(text) == F.octet_length(text), plain).otherwise(other)
    return F.transform(found, lambda c: F.encode(c, "ISO-8859-1"))


def chunk_recipes(docs: DataFrame, text="text", name=F.xxhash64, least: int = MIN_CHUNK, most: int = MAX_CHUNK, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all of them, if none are given) of docs' rows, with `recipe` (array<bigint>, names of the chunks in order), `variants` and a number `_row`.

    Equal (recipe, variants) means equal text. `variants` is null unless a name of the recipe stands
    for several contents; then it lists, for each chunk, its content's rank under the name. Null text
    counts as empty; an empty text has an empty recipe. Columns of docs by one of the new names, or
    `_chunks`, are replaced. Each text is cut once: chunks and recipes are written together.
    """
    new = ["recipe", "variants", "_row", "_chunks"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in new]
    # One expression, so that it is evaluated once.
    named = F.transform(chunks(F.coalesce(F.col(text), F.lit("")), least, most), lambda c: F.struct(name(c).alias("name"), c.alias("chunk")))
    cut = written(docs.select(*own, named.alias("_chunks"), F.monotonically_increasing_id().alias("_row")), "chunks")
    each = cut.select("_row", F.posexplode("_chunks").alias("pos", "c")).select("_row", "pos", "c.name", "c.chunk")
    distinct = each.groupBy("name", "chunk").agg(F.count(F.lit(1)).alias("n"))
    clash = written(distinct.groupBy("name").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("name"), "chunk-clash")
    recipes = cut.select(*own, F.col("_chunks.name").alias("recipe"), "_row")
    if clash.isEmpty():
        return recipes.withColumn("variants", F.lit(None).cast("array<bigint>"))
    # Ranks by content, of the contents under the few clashing names only.
    distinct = written(distinct.join(clash, "name", "left_semi").groupBy("name").agg(F.sort_array(F.collect_list("chunk")).alias("contents")), "chunk-variants")
    ranks = each.join(distinct, "name").select("_row", F.struct("pos", F.expr("cast(array_position(contents, chunk) as bigint)").alias("rank")).alias("v"))
    ranks = ranks.groupBy("_row").agg(F.sort_array(F.collect_list("v")).alias("v"))
    variants = ranks.select("_row", F.flatten(F.transform("v", lambda x: F.array(x["pos"].cast("bigint"), x["rank"]))).alias("variants"))
    return recipes.join(variants, "_row", "left")


def exact_dedup(docs: DataFrame, id="doc_id", text="text", name=F.xxhash64, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest id stays; of repeated rows with that id, one stays. Null ids come after all others; a
    group of null ids only has keep_id null, and one of its rows stays. Other columns are ignored.
    """
    rows = docs.select(F.col(id).alias("_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    rows = rows.withColumn("text_sha256", F.sha2("_text", 256))
    rows = chunk_recipes(rows, "_text", name, least, most, keep=["_id", "text_sha256"]).withColumn("variants", F.coalesce("variants", F.array().cast("array<bigint>")))
    groups = rows.groupBy("recipe", "variants").agg(F.max(F.struct("_id", "_row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    # Written, so that the join has an exchange of its own on either side and a hot group's rows can be split.
    groups = written(groups.filter("group_size > 1"), "groups")
    out = rows.join(groups, ["recipe", "variants"], "left")
    alone = F.col("group_size").isNull()
    return out.select(F.col("_id").alias(id), F.when(alone, F.col("_id")).otherwise(F.col("last._id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), (alone | (F.col("_row") == F.col("last._row"))).alias("kept"), "text_sha256")


def keep_exact(docs: DataFrame, id="doc_id", text="text", **options) -> DataFrame:
    """docs' rows that exact_dedup() keeps, with all columns; of rows with the same id and text any one.

    Null text counts as empty: of null and empty texts the row with the largest id stays. Columns may have
    any names; an empty table gives an empty one.
    """
    names = docs.columns
    docs, (id, text) = numbered_columns(docs, id, text)
    found = exact_dedup(docs, id, text, **options).select(F.col(id).alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    pairs = written(found.groupBy("_id", "_sha").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("not _kept or _n > 1"), "dropped")
    rows = docs.withColumns({"_id": F.col(id), "_sha": F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))), 256)})
    out = without(rows, pairs.select("_id", "_sha"), ["_id", "_sha"]).select(docs.columns)
    again = pairs.filter("_kept").select(F.col("_id").alias("_id2"), F.col("_sha").alias("_sha2"))
    if again.isEmpty():
        return out.toDF(*names)
    same = rows.join(again, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_sha") == F.col("_sha2")))
    return out.unionByName(same.withColumn("_n", F.row_number().over(W.partitionBy("_id", "_sha").orderBy(F.lit(0)))).filter("_n = 1").select(docs.columns)).toDF(*names)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
