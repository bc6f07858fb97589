"""Registered queries: each operator over whole tables, with SQL that says the same.

The matrix is orders x parts, a value the quantity ordered; rows without lines are empty rows. Features
have a group for each part type, and one more, which overlaps, for large parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .matrix import SparseMatrix, dense_entries, triplets
from .operators import access, align, layout, ordering, reduce, repack, union, validate
from .plans import partition as plan
from .scratch import scratch_path

QUERIES, SQL = {}, {}
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
GROUPS = len(TYPES) + 1
FILTER = reduce.GroupFilter(min_total=20, min_detected=2, max_fraction=0.6, group=2)

# CTEs that the SQL below builds on.
T = """T AS (SELECT l_orderkey AS "row", l_partkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)"""
V = """V AS (SELECT p_partkey AS col, p_size >= 5 AS feature_keep, p_type, p_size FROM part)"""
WITH = f"WITH {T}, {V} "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entries(spark, d) -> DataFrame:
    """An order has a few lines: its row is short."""
    return triplets(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", short_rows=True)


def rows_of(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_orderstatus") != "F").alias("row_keep"))


def features_of(spark, d) -> DataFrame:
    kind = F.lit(0)
    for g, t in enumerate(TYPES):
        kind = F.when(F.col("p_type") == t, 1 << g).otherwise(kind)
    large = F.when(F.col("p_size") > 25, 1 << len(TYPES)).otherwise(0)
    return read(spark, d, "part").select(F.col("p_partkey").alias("col"), (F.col("p_size") >= 5).alias("feature_keep"), kind.bitwiseOR(large).alias("group_mask"))


def n_rows(spark, d) -> int:
    return read(spark, d, "orders").count()


def n_cols(spark, d) -> int:
    return read(spark, d, "part").count()


def _reduce_sql(masked: bool) -> str:
    sums = ", ".join([*[f"sum(CASE WHEN p_type = '{t}' THEN value ELSE 0 END) AS g{g}" for g, t in enumerate(TYPES)], f"sum(CASE WHEN p_size > 25 THEN value ELSE 0 END) AS g{len(TYPES)}"])
    live = "o_orderstatus <> 'F'" if masked else "true"
    keep = "feature_keep" if masked else "true"
    zero = lambda c: f"CASE WHEN live THEN coalesce({c}, 0) ELSE 0 END AS {c}"
    cols = ", ".join(zero(c) for c in ("total", "detected", "max_value", *[f"g{g}" for g in range(GROUPS)]))
    pct = ", ".join(f"CASE WHEN total > 0 THEN 100.0::DOUBLE * g{g} / total ELSE 0 END AS pct{g}" for g in range(GROUPS))
    return f"""{WITH}, B AS (SELECT "row", sum(value) AS total, count(*) AS detected, max(value) AS max_value, {sums} FROM T JOIN V USING (col) WHERE {keep} GROUP BY 1),
    R AS (SELECT o_orderkey AS "row", {live} AS live, {cols} FROM (SELECT *, {live} AS live FROM orders LEFT JOIN B ON o_orderkey = "row"))
    SELECT "row", total::DOUBLE AS total, detected, max_value::DOUBLE AS max_value, {", ".join(f"g{g}::DOUBLE AS g{g}" for g in range(GROUPS))}, {pct},
      (live AND total >= 20 AND detected >= 2 AND (CASE WHEN total > 0 THEN g2 / total ELSE 0 END) <= 0.6)::INT AS keep FROM R"""


@query(_reduce_sql(True))
def masked_group_reduce(spark, d):
    return reduce.group_reduce(entries(spark, d), rows_of(spark, d), features_of(spark, d), GROUPS, FILTER)


@query(_reduce_sql(False))
def masked_group_reduce_nomask(spark, d):
    return reduce.group_reduce(entries(spark, d), rows_of(spark, d).select("row"), features_of(spark, d).drop("feature_keep"), GROUPS, FILTER)


@query(f'SELECT "row", total, detected FROM ({_reduce_sql(True)}) WHERE keep = 1')
def qc_keep_rows(spark, d):
    return masked_group_reduce(spark, d).filter("keep = 1").select("row", "total", "detected")


@query(f'{WITH} SELECT o_orderkey AS "row", coalesce(sum(value), 0)::DOUBLE AS total, count(value) AS detected, coalesce(max(value), 0)::DOUBLE AS max_value FROM orders LEFT JOIN T ON o_orderkey = "row" GROUP BY 1')
def row_totals(spark, d):
    return reduce.group_reduce(entries(spark, d), rows_of(spark, d).select("row")).select("row", "total", "detected", "max_value")


@query(f'{WITH} SELECT "row", count(*) AS nnz FROM T GROUP BY 1')
def row_nnz(spark, d):
    return reduce.row_counts(entries(spark, d))


@query(f'{WITH} SELECT "row", col, value FROM T WHERE "row" = 7 AND col = (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 7)')
def matrix_point(spark, d):
    col = read(spark, d, "lineitem").filter("l_orderkey = 7").agg(F.min("l_partkey")).first()[0]
    return access.point(entries(spark, d), 7, col if col is not None else -1)


@query(f'{WITH}, R(ord, r) AS (VALUES (0, 5), (1, 3), (2, 5), (3, 100), (4, 0), (5, 3)) SELECT ord::BIGINT AS ord, r::BIGINT AS "row", col, value FROM R LEFT JOIN T ON r = "row"')
def rows_gather(spark, d):
    return access.gather(entries(spark, d), access.request(spark, [5, 3, 5, 100, 0, 3], n_rows(spark, d)))


@query(f'{WITH} SELECT "row" - 100 AS "row", col, value FROM T WHERE "row" >= 100 AND "row" < 300')
def row_range(spark, d):
    return access.read_range(entries(spark, d), 100, 200, n_rows(spark, d))


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10")
def head_rows(spark, d):
    return access.head(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 10)


def _text(df: DataFrame, *arrays: str, whole: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({a: F.array_join(F.transform(a, lambda x: x.cast("bigint").cast("string")), ",") for a in arrays})


@query(f'{WITH} SELECT o_orderkey AS "row", coalesce(string_agg(col::VARCHAR, \',\' ORDER BY col), \'\') AS cols, coalesce(string_agg(value::BIGINT::VARCHAR, \',\' ORDER BY col), \'\') AS vals FROM orders LEFT JOIN T ON o_orderkey = "row" GROUP BY 1')
def row_csr(spark, d):
    return _text(access.csr(entries(spark, d), rows_of(spark, d)), "cols", "vals")


@query(f'{WITH} SELECT o_orderkey AS "row", (sum(count(col)) OVER (ORDER BY o_orderkey) - count(col))::BIGINT AS row_begin, (sum(count(col)) OVER (ORDER BY o_orderkey))::BIGINT AS row_end FROM orders LEFT JOIN T ON o_orderkey = "row" GROUP BY 1')
def row_offsets(spark, d):
    return access.indptr(access.csr(entries(spark, d), rows_of(spark, d)))


def _sizes_selection(spark, d):
    """Parts of size 10 in descending order of their key."""
    from .scratch import dense_index

    return dense_index(read(spark, d, "part").filter("p_size = 10").select(F.col("p_partkey").alias("col")), [F.col("col").desc()], "new_col")


_S = "S AS (SELECT p_partkey AS col, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS new_col FROM part WHERE p_size = 10)"


@query(f'{WITH}, {_S} SELECT "row", new_col AS col, value FROM T JOIN S USING (col)')
def feature_subset(spark, d):
    return access.select_features(entries(spark, d), _sizes_selection(spark, d))


_U = """U AS (SELECT o_orderkey AS "row", row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS new_row FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _urgent(spark, d):
    from .scratch import dense_index

    return dense_index(read(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("row")), [F.col("row").desc()], "new_row")


@query(f'{WITH}, {_S}, {_U} SELECT new_row AS "row", new_col AS col, value FROM T JOIN S USING (col) JOIN U USING ("row")')
def derived_subset(spark, d):
    return access.derived(entries(spark, d), _urgent(spark, d), _sizes_selection(spark, d))


@query(f"""WITH {_U} SELECT new_row AS "row", o_orderstatus, CASE WHEN new_row < 100 THEN 'late' WHEN new_row >= 150 AND new_row < 200 THEN 'early' ELSE '' END AS row_group FROM orders JOIN U ON o_orderkey = "row" """)
def group_labels(spark, d):
    obs = read(spark, d, "orders").select(F.col("o_orderkey").alias("row"), "o_orderstatus")
    return access.annotate(obs, "row", _urgent(spark, d), [(0, 100, "late"), (150, 200, "early")], "row_group")


_CR = """CR AS (SELECT o_orderkey AS "row", row_number() OVER (ORDER BY o_orderkey) - 1 AS new_row FROM orders WHERE o_orderstatus <> 'F')"""
_CC = """CC AS (SELECT p_partkey AS col, row_number() OVER (ORDER BY p_partkey) - 1 AS new_col FROM part WHERE p_size >= 5)"""


@query(f'WITH {_CR} SELECT "row", new_row FROM CR')
def compact_rows(spark, d):
    return access.compact(rows_of(spark, d), "row", "row_keep")


@query(f'{WITH}, {_CR}, {_CC} SELECT new_row AS "row", new_col AS col, value FROM T JOIN CR USING ("row") JOIN CC USING (col)')
def compact_finalize(spark, d):
    obs = rows_of(spark, d).withColumnRenamed("row_keep", "keep")
    var = features_of(spark, d).select("col", F.col("feature_keep").alias("keep"))
    return access.finalize(entries(spark, d), obs, var)[0]


@query(f"""{WITH} SELECT T."row", col, value FROM T JOIN V USING (col) JOIN orders ON o_orderkey = "row" WHERE feature_keep AND o_orderstatus <> 'F' """)
def masked_entries(spark, d):
    return access.keep_masked(entries(spark, d), rows_of(spark, d).withColumnRenamed("row_keep", "keep"), features_of(spark, d).withColumnRenamed("feature_keep", "keep"))


@query(f"""{WITH}, {_CR}, {_CC}, A AS (SELECT T."row", col, value FROM T JOIN CR USING ("row") JOIN CC USING (col))
SELECT (SELECT count(*) FROM CR) AS kept_rows, (SELECT count(*) FROM CC) AS kept_features, (SELECT count(*) FROM A) AS live_nnz,
 (SELECT (max("row") + 2) * 4 + count(*) * 6 FROM T) AS bytes_before, ((SELECT count(*) FROM CR) + 1) * 4 + (SELECT count(*) FROM A) * 6 AS bytes_after, (SELECT count(*) FROM A)::DOUBLE / (SELECT count(*) FROM T) AS live_fill""")
def masked_rebuild_stats(spark, d):
    rows, cols = access.compact(rows_of(spark, d), "row", "row_keep"), access.compact(features_of(spark, d), "col", "feature_keep")
    t = entries(spark, d)
    return access.rebuild_stats(t, access.remap(t, rows, cols), rows.count(), cols.count())


@query(f'{WITH} SELECT o_orderpriority, count(DISTINCT o_orderkey) AS rows, count(col) AS nnz FROM orders LEFT JOIN T ON o_orderkey = "row" GROUP BY 1')
def source_totals(spark, d):
    obs = read(spark, d, "orders").select(F.col("o_orderkey").alias("row"), "o_orderpriority")
    return access.source_totals(entries(spark, d), obs, "o_orderpriority")


@query(f"""{WITH}, N AS (SELECT count(*)::DOUBLE AS n FROM orders), B AS (SELECT col, sum(value) AS s, sum(value * value) AS q, count(*) AS c FROM T GROUP BY 1),
R AS (SELECT p_partkey AS col, coalesce(s, 0)::DOUBLE AS feature_sum, coalesce(q, 0)::DOUBLE AS feature_sq_sum, coalesce(c, 0) AS detected, n FROM part LEFT JOIN B ON col = p_partkey, N)
SELECT col, feature_sum, feature_sq_sum, detected, feature_sum / n AS mean, feature_sq_sum / n - (feature_sum / n) * (feature_sum / n) AS variance, (feature_sum >= 100 AND detected >= 5 AND feature_sq_sum / n - (feature_sum / n) * (feature_sum / n) >= 0.3)::INT AS keep FROM R""")
def feature_stats(spark, d):
    return reduce.feature_stats(entries(spark, d), features_of(spark, d), n_rows(spark, d), min_sum=100, min_detected=5, min_variance=0.3)


@query(f"""{WITH}, N AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, col, sum(value) / any_value(n) AS mean
FROM T JOIN orders ON o_orderkey = "row" JOIN N USING (o_orderpriority) JOIN part ON p_partkey = col WHERE p_size = 10 GROUP BY 1, 2""")
def browse_group_mean(spark, d):
    obs = read(spark, d, "orders").select(F.col("o_orderkey").alias("row"), "o_orderpriority")
    return reduce.group_means(entries(spark, d), obs, "o_orderpriority", _sizes_selection(spark, d))


SHARD = 1000


def _spans(spark, d, id="shard_id", width=SHARD):
    n = n_rows(spark, d)
    return plan.spans_table(spark, [*range(0, n, width), n], id)


@query(f'{WITH} SELECT o_orderkey // {SHARD} AS shard_id, count(DISTINCT o_orderkey) AS rows, count(col) AS nnz FROM orders LEFT JOIN T ON o_orderkey = "row" GROUP BY 1')
def shard_rollup(spark, d):
    return reduce.rollup_counts(reduce.row_counts(entries(spark, d)), _spans(spark, d), "shard_id")


@query(f'{WITH} SELECT "row", "row" // {SHARD} AS shard_id, count(*) AS nnz FROM T GROUP BY 1')
def shard_of_rows(spark, d):
    return access.span_of(reduce.row_counts(entries(spark, d)), "row", _spans(spark, d), "shard_id").select("row", "shard_id", "nnz")


@query(f'{WITH}, N AS (SELECT count(*) AS n FROM orders) SELECT "row", col, value FROM T UNION ALL SELECT "row" + n, col, value FROM T, N')
def concat_rows(spark, d):
    m = SparseMatrix(entries(spark, d), n_rows(spark, d), n_cols(spark, d))
    return union.concat_rows(m, m).entries


def _two_sources(spark, d):
    """Features of two sources: parts of size up to 30 in order, and those from 20 on in reverse order."""
    from .scratch import dense_index

    p = read(spark, d, "part").select("p_partkey", "p_size")
    f = lambda cond, by, s: dense_index(p.filter(cond), [by], "local_col").select(F.lit(s).alias("source"), "local_col", F.col("p_partkey").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("gene").alias("type"))
    return f("p_size <= 30", F.col("p_partkey"), 0).unionByName(f("p_size >= 20", F.col("p_partkey").desc(), 1))


_TWO = """F AS (SELECT 0 AS source, row_number() OVER (ORDER BY p_partkey) - 1 AS local_col, p_partkey FROM part WHERE p_size <= 30
UNION ALL SELECT 1, row_number() OVER (ORDER BY p_partkey DESC) - 1, p_partkey FROM part WHERE p_size >= 20),
G AS (SELECT p_partkey, row_number() OVER (ORDER BY s, l) - 1 AS global_col FROM (SELECT p_partkey, min(source) AS s, arg_min(local_col, source) AS l FROM F GROUP BY 1))"""


@query(f"WITH {_TWO} SELECT source, local_col, global_col FROM F JOIN G USING (p_partkey)")
def feature_union(spark, d):
    return union.feature_union(_two_sources(spark, d))


@query(f"""{WITH}, {_TWO}, E AS (SELECT "row" % 2 AS source, "row" // 2 AS r, p_partkey, value FROM T JOIN part ON p_partkey = col),
N AS (SELECT count(*) FILTER (o_orderkey % 2 = 0) AS n FROM orders)
SELECT r + CASE WHEN source = 1 THEN n ELSE 0 END AS "row", global_col AS col, value FROM E JOIN F USING (source, p_partkey) JOIN G USING (p_partkey), N""")
def union_sources(spark, d):
    f = _two_sources(spark, d)
    mapping = union.feature_union(f)
    t = entries(spark, d).select((F.col("row") % 2).cast("int").alias("source"), (F.col("row") / 2).cast("bigint").alias("row"), F.col("col").cast("string").alias("id"), "value")
    t = t.join(f.select("source", "id", "local_col"), ["source", "id"]).select("source", "row", F.col("local_col").alias("col"), "value")
    even, odd = read(spark, d, "orders").agg(F.count_if(F.col("o_orderkey") % 2 == 0), F.count_if(F.col("o_orderkey") % 2 == 1)).first()
    spans = spark.createDataFrame(union.source_spans([(0, even), (1, odd)]), "source int, row_begin bigint, row_end bigint")
    return union.union_sources(t, mapping, spans)


def _row_map(spark, d):
    """Customers with orders, and users with events, as assays over the customers."""
    from .scratch import dense_index

    def side(t, key, name):
        own = dense_index(read(spark, d, t).select(F.col(key).alias("global_row")).distinct(), ["global_row"], "assay_row")
        return own.select(F.lit(name).alias("assay_id"), "global_row", "assay_row")

    return side("orders", "o_custkey", "orders").unionByName(side("events", "user_id", "events"))


_M = """M AS (SELECT 'orders' AS assay_id, g AS global_row, row_number() OVER (ORDER BY g) - 1 AS assay_row FROM (SELECT DISTINCT o_custkey AS g FROM orders)
UNION ALL SELECT 'events', g, row_number() OVER (ORDER BY g) - 1 FROM (SELECT DISTINCT user_id AS g FROM events))"""


@query(f"WITH {_M} SELECT coalesce(a.global_row, b.global_row) AS global_row, a.assay_row AS left_row, b.assay_row AS right_row FROM (SELECT * FROM M WHERE assay_id = 'orders') a FULL JOIN (SELECT * FROM M WHERE assay_id = 'events') b ON a.global_row = b.global_row")
def pair_full_outer(spark, d):
    return align.paired_rows(_row_map(spark, d), "orders", "events")


@query(f"WITH {_M} SELECT c_custkey AS global_row, max(assay_row) FILTER (assay_id = 'orders') AS orders, max(assay_row) FILTER (assay_id = 'events') AS events FROM customer LEFT JOIN M ON c_custkey = global_row GROUP BY 1")
def resolve_rows(spark, d):
    return align.resolve_rows(_row_map(spark, d), read(spark, d, "customer").select(F.col("c_custkey").alias("global_row")), ["orders", "events"])


@query(f"WITH {_M} SELECT assay_id, count(*) AS rows, count(*) = (SELECT count(*) FROM customer) AS exact FROM M GROUP BY 1")
def pairing_report(spark, d):
    return align.pairing_report(_row_map(spark, d), read(spark, d, "customer").count())


@query(f"WITH {_M} SELECT c_custkey AS global_row, assay_row FROM customer LEFT JOIN M ON global_row = c_custkey AND assay_id = 'events'")
def assay_rows(spark, d):
    return align.assay_row(_row_map(spark, d), "events", read(spark, d, "customer").select(F.col("c_custkey").alias("global_row")))


@query(f"""WITH {_M}, W AS (SELECT DISTINCT c_custkey // 100 AS window_id FROM customer), A AS (SELECT DISTINCT assay_id FROM M), B AS (SELECT global_row // 100 AS window_id, assay_id, min(assay_row) AS lo, max(assay_row) AS hi, count(*) AS n FROM M GROUP BY 1, 2)
SELECT window_id, assay_id, coalesce(lo, 0) AS local_begin, coalesce(hi + 1, 0) AS local_end, coalesce(hi - lo + 1 = n, true) AS contiguous FROM W CROSS JOIN A LEFT JOIN B USING (window_id, assay_id)""")
def local_windows(spark, d):
    n = read(spark, d, "customer").count()
    return align.local_window(_row_map(spark, d), plan.spans_table(spark, [*range(0, n, 100), n], "window_id"))


@query(f'{WITH} SELECT col AS "row", "row" AS col, value FROM T')
def transpose(spark, d):
    return layout.transpose(entries(spark, d))


@query(f"{WITH} SELECT p_partkey AS col, coalesce(string_agg(\"row\"::VARCHAR, ',' ORDER BY \"row\"), '') AS rows, coalesce(string_agg(value::BIGINT::VARCHAR, ',' ORDER BY \"row\"), '') AS vals FROM part LEFT JOIN T ON col = p_partkey GROUP BY 1")
def csc(spark, d):
    return _text(layout.csc(entries(spark, d), features_of(spark, d)), "rows", "vals")


@query(f'{WITH} SELECT "row", col, value FROM T')
def csr_to_coo(spark, d):
    return layout.from_csr(access.csr(entries(spark, d)))


@query('SELECT vec_id AS "row", (i - 1)::BIGINT AS col, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i) WHERE embedding[i] <> 0')
def dense_from_embeddings(spark, d):
    return dense_entries(read(spark, d, "embeddings"), "vec_id", "embedding")


_P = """T2 AS (SELECT "row", col % 8 AS col, sum(value) AS value FROM T GROUP BY 1, 2)"""


@query(f"""{WITH}, {_P} SELECT o_orderkey AS "row", string_agg(coalesce(value, 0)::BIGINT::VARCHAR, ',' ORDER BY c) AS vals FROM orders CROSS JOIN range(8) r(c) LEFT JOIN T2 ON "row" = o_orderkey AND col = c GROUP BY 1""")
def dense_rows(spark, d):
    few = entries(spark, d).withColumn("col", F.col("col") % 8).groupBy("row", "col").agg(F.sum("value").alias("value"))
    return _text(layout.dense(few, rows_of(spark, d), 8), "vals")


_BAND = """K AS (SELECT "row", col, value FROM T WHERE abs("row" - col) <= 5)"""


@query(f"""{WITH}, {_BAND} SELECT col - "row" AS diag_offset, string_agg("row"::VARCHAR, ',' ORDER BY "row") AS rows, string_agg(value::BIGINT::VARCHAR, ',' ORDER BY "row") AS vals FROM K GROUP BY 1""")
def band_diagonals(spark, d):
    return _text(layout.diagonals(entries(spark, d).filter(F.abs(F.col("row") - F.col("col")) <= 5)), "rows", "vals")


@query(f"""{WITH} SELECT col - "row" AS diag_offset, string_agg("row"::VARCHAR, ',' ORDER BY "row") AS rows, string_agg(value::BIGINT::VARCHAR, ',' ORDER BY "row") AS vals FROM T GROUP BY 1""")
def all_diagonals(spark, d):
    return _text(layout.diagonals(entries(spark, d)), "rows", "vals")


@query(f"""{WITH}, N AS (SELECT count(*) AS n FROM orders), S(b) AS (VALUES (4), (8), (16), (32)), D AS (SELECT DISTINCT b, "row" // b AS rb, col // b AS cb FROM T, S), P AS (SELECT b, rb, count(*) AS c FROM D GROUP BY 1, 2)
SELECT b::BIGINT AS block_size, max(c) AS width, ((n + b - 1) // b)::BIGINT AS row_blocks, sum(c)::BIGINT AS blocks, (n * max(c) * b * 2)::BIGINT AS padded_bytes, sum(c)::DOUBLE / (((n + b - 1) // b) * max(c)) AS fill FROM P, N GROUP BY b, n""")
def blocked_ell_tune(spark, d):
    return layout.tune_blocked_ell(entries(spark, d), n_rows(spark, d))


@query(f"""{WITH}, D AS (SELECT DISTINCT "row" // 16 AS row_block, col // 16 AS b FROM T), A AS (SELECT row_block, count(*) AS c, string_agg(b::VARCHAR, ',' ORDER BY b) AS s FROM D GROUP BY 1), X AS (SELECT max(c) AS w FROM A)
SELECT o.row_block, coalesce(s, '') || CASE WHEN coalesce(c, 0) = 0 THEN repeat('-1,', w)[:-2] ELSE repeat(',-1', w - c) END AS slots FROM (SELECT DISTINCT o_orderkey // 16 AS row_block FROM orders) o LEFT JOIN A ON A.row_block = o.row_block, X""")
def blocked_ell_slots(spark, d):
    return _text(layout.blocked_ell_slots(layout.blocked_ell(entries(spark, d), 16), n_rows(spark, d), 16), "slots")


@query(f'{WITH} SELECT "row", col, value FROM T')
def blocked_ell_round_trip(spark, d):
    return layout.from_blocked_ell(layout.blocked_ell(entries(spark, d), 8), 8)


@query(f"""{WITH}, N AS (SELECT count(*) AS n FROM orders), H(h) AS (VALUES (8), (16), (32), (64)), Z AS (SELECT "row", count(*) AS c FROM T GROUP BY 1), P AS (SELECT h, "row" // h AS s, max(c) AS w, sum(c) AS c FROM Z, H GROUP BY 1, 2)
SELECT h::BIGINT AS slice_rows, ((n + h - 1) // h)::BIGINT AS slices, sum(w * least(h, n - s * h))::BIGINT AS slots, sum(w * least(h, n - s * h))::DOUBLE / sum(c) + 0.25::DOUBLE * ((n + h - 1) // h) / n AS score, (sum(w * least(h, n - s * h)) * 6 + ((n + h - 1) // h) * 8)::BIGINT AS bytes FROM P, N GROUP BY h, n""")
def sliced_ell_tune(spark, d):
    return layout.tune_sliced_ell(entries(spark, d), n_rows(spark, d))


@query(f"""{WITH}, C AS (SELECT o_orderkey AS "row", count(col) AS n FROM orders LEFT JOIN T ON "row" = o_orderkey GROUP BY 1) SELECT "row" // 32 AS slice, "row", max(n) OVER (PARTITION BY "row" // 32)::INT AS width, (max(n) OVER (PARTITION BY "row" // 32) - n)::INT AS padding FROM C""")
def sliced_ell_widths(spark, d):
    s = layout.sliced_ell(entries(spark, d), rows_of(spark, d), 32)
    return s.select("slice", "row", "width", F.size(F.filter("cols", lambda c: c < 0)).alias("padding"))


@query(f'{WITH} SELECT "row", col, value FROM T')
def sliced_ell_round_trip(spark, d):
    return layout.from_sliced_ell(layout.sliced_ell(entries(spark, d), rows_of(spark, d), 32))


def _scale(spark, d):
    return features_of(spark, d).select("col", F.lit(0.5).alias("scale"), (F.col("col") % 4).cast("double").alias("offset"))


@query(f'{WITH} SELECT "row", col, least(127, greatest(-128, round_even((value - col % 4) / 0.5, 0)))::INT AS code FROM T')
def quantized_codes(spark, d):
    return layout.quantize(entries(spark, d), _scale(spark, d))


@query(f'{WITH} SELECT "row", col, least(127, greatest(-128, round_even((value - col % 4) / 0.5, 0))) * 0.5::DOUBLE + col % 4 AS value FROM T')
def quantized_round_trip(spark, d):
    return layout.dequantize(layout.quantize(entries(spark, d), _scale(spark, d)), _scale(spark, d))


_NNZ = """C AS (SELECT o_orderkey AS "row", count(col) AS nnz FROM orders LEFT JOIN T ON "row" = o_orderkey GROUP BY 1)"""


@query(f'{WITH}, {_NNZ} SELECT "row", nnz, row_number() OVER (ORDER BY nnz, "row") - 1 AS rank, ntile(7) OVER (ORDER BY nnz, "row") - 1 AS bucket FROM C')
def nnz_buckets(spark, d):
    return ordering.nnz_buckets(entries(spark, d), rows_of(spark, d), 7, n_rows(spark, d))


@query(f'{WITH}, {_NNZ} SELECT "row" // {SHARD} AS shard_id, "row", nnz, row_number() OVER w - 1 AS rank, ntile(8) OVER w - 1 AS bucket FROM C WINDOW w AS (PARTITION BY "row" // {SHARD} ORDER BY nnz, "row")')
def shard_nnz_buckets(spark, d):
    shards = rows_of(spark, d).select("row", F.floor(F.col("row") / SHARD).alias("shard_id"))
    return ordering.shard_nnz_buckets(entries(spark, d), shards, 8)


@query(f"""{WITH}, C AS (SELECT o_orderkey AS "row", count(col) AS nnz, coalesce(string_agg(col::VARCHAR, ',' ORDER BY col), '') AS cols FROM orders LEFT JOIN T ON "row" = o_orderkey GROUP BY 1)
SELECT "row" // {SHARD} AS shard_id, ntile(8) OVER w - 1 AS bucket, row_number() OVER w - 1 AS exec_row, "row", cols FROM C WINDOW w AS (PARTITION BY "row" // {SHARD} ORDER BY nnz, "row")""")
def shard_bucket_rows(spark, d):
    shards = rows_of(spark, d).select("row", F.floor(F.col("row") / SHARD).alias("shard_id"))
    return _text(repack.shard_buckets_view(entries(spark, d), shards, 8), "cols").drop("vals")


@query(f'{WITH}, B AS (SELECT p_partkey AS col, sum("row")::DOUBLE / count("row") AS m FROM part LEFT JOIN T ON col = p_partkey GROUP BY 1) SELECT col, row_number() OVER (ORDER BY m NULLS LAST, col) - 1 AS pos FROM B')
def barycenter_order(spark, d):
    return ordering.barycenter_order(entries(spark, d), features_of(spark, d), "col")


@query()
def signature_order(spark, d):
    return ordering.signature_order(entries(spark, d), features_of(spark, d), 16)


@query(f'{WITH}, B AS (SELECT p_partkey AS col, row_number() OVER (ORDER BY sum("row")::DOUBLE / count("row") NULLS LAST, p_partkey) - 1 AS pos FROM part LEFT JOIN T ON col = p_partkey GROUP BY 1) SELECT "row", pos AS col, value FROM T JOIN B USING (col)')
def reordered_columns(spark, d):
    order = barycenter_order(spark, d).select(F.col("col").alias("old"), F.col("pos").alias("new"))
    return ordering.apply_order(entries(spark, d), cols=order)


@query(f'{WITH}, N AS (SELECT (count(*) + 99) // 100 AS s FROM orders) SELECT "row" // s AS "row", col, value FROM T, N WHERE "row" % s = 0')
def systematic_sample(spark, d):
    return ordering.systematic_sample(entries(spark, d), n_rows(spark, d), 100)


@query(f"""{WITH}, {_NNZ}, R AS (SELECT nnz, row_number() OVER (ORDER BY nnz, "row") - 1 AS r, count(*) OVER () AS n FROM C), K AS (SELECT k, ((r + 1) * k - 1) // n AS b, count(*) AS c, max(nnz) AS w FROM R, range(1, 9) x(k) GROUP BY 1, 2)
SELECT k AS buckets, sum(16 + 6 * c * w)::BIGINT AS bytes FROM K GROUP BY 1""")
def bucket_costs(spark, d):
    return ordering.bucket_costs(entries(spark, d), rows_of(spark, d), n_rows(spark, d))


@query(f"""{WITH.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_NNZ}, S AS (SELECT "row", sum(nnz) OVER (ORDER BY "row") AS c FROM C),
P(id, b, base) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL SELECT id + 1, x."row", (x.c - y.nnz)::BIGINT FROM P, LATERAL (SELECT S."row", S.c FROM S WHERE S.c > P.base + 2000 ORDER BY S."row" LIMIT 1) x, LATERAL (SELECT nnz FROM C WHERE C."row" = x."row") y)
SELECT C."row", max(P.id) AS partition_id FROM C JOIN P ON P.b <= C."row" GROUP BY 1""")
def partition_by_nnz(spark, d):
    nnz = rows_of(spark, d).select("row").join(reduce.row_counts(entries(spark, d)), "row", "left").fillna(0, ["nnz"])
    return plan.partition_table(nnz, 2000)


@query(f"""{WITH}, N AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS k FROM orders), D AS (SELECT "row" // 8 AS rb, count(DISTINCT col // 8) AS c FROM T GROUP BY 1), X AS (SELECT max(c) AS w FROM D),
L AS (SELECT count(*) AS live FROM T JOIN V USING (col) JOIN orders ON o_orderkey = "row" WHERE feature_keep AND o_orderstatus <> 'F')
SELECT (n * w * 8)::BIGINT AS slots, (k * w * 8)::BIGINT AS kept_row_slots, live, (n * w * 8 - live)::BIGINT AS dead_slots, live::DOUBLE / (n * w * 8) AS live_fill_ratio, ((n * w * 8 - live) * 2)::BIGINT AS dead_value_bytes FROM N, X, L""")
def filter_stats(spark, d):
    keep = lambda t, c: t.withColumnRenamed(c, "keep")
    return repack.filter_stats(entries(spark, d), n_rows(spark, d), n_cols(spark, d), 8, keep(rows_of(spark, d), "row_keep"), keep(features_of(spark, d), "feature_keep"))


@query(f"""{WITH}, C AS (SELECT o_orderkey AS "row", count(col) AS nnz, coalesce(string_agg(col::VARCHAR, ',' ORDER BY col), '') AS cols FROM orders LEFT JOIN T ON "row" = o_orderkey GROUP BY 1)
SELECT ntile(5) OVER w - 1 AS bucket, row_number() OVER w - 1 AS exec_row, "row", cols FROM C WINDOW w AS (ORDER BY nnz, "row")""")
def bucketed_rows(spark, d):
    view, _ = repack.bucketed_view(entries(spark, d), rows_of(spark, d), n_rows(spark, d), 5)
    return _text(view, "cols").drop("vals")


@query(f"""{WITH}, N AS (SELECT (count(*) + 15) // 16 AS n FROM orders), B AS (SELECT o_orderkey // 16 AS row_block, count(DISTINCT col // 16) AS width FROM orders LEFT JOIN T ON "row" = o_orderkey GROUP BY 1)
SELECT row_block, width, row_number() OVER w - 1 AS pos, (row_number() OVER w * 4 - 1) // n AS segment FROM B, N WINDOW w AS (ORDER BY row_block = n - 1, width, row_block)""")
def width_segments(spark, d):
    n = -(-n_rows(spark, d) // 16)
    return repack.width_segments(layout.blocked_ell(entries(spark, d), 16), n, 4)


@query(f"{WITH} SELECT o_orderkey // {SHARD} AS shard_id, (o_orderkey // {SHARD}) % 4 AS device, count(col) AS nnz FROM orders LEFT JOIN T ON o_orderkey = \"row\" GROUP BY 1")
def place_round_robin(spark, d):
    rolled = shard_rollup(spark, d)
    devices = spark.createDataFrame([*enumerate(plan.round_robin(rolled.count(), 4))], "shard_id bigint, device int")
    return rolled.join(devices, "shard_id").select("shard_id", F.col("device").cast("bigint").alias("device"), "nnz")


@query()
def place_by_bytes(spark, d):
    got = sorted((r.shard_id, layout.byte_sizes(r.rows, r.nnz)["csr"]) for r in shard_rollup(spark, d).collect())
    at = plan.by_bytes([b for _, b in got], 4)
    return spark.createDataFrame([(s, b, dev) for (s, b), dev in zip(got, at, strict=True)], "shard_id bigint, bytes bigint, device int")


@query(f'{WITH} SELECT o_orderkey // {SHARD} AS shard_id, ((count(DISTINCT o_orderkey) + 1) * 4 + count(col) * 6)::BIGINT AS csr_bytes, (count(col) * 10)::BIGINT AS coo_bytes FROM orders LEFT JOIN T ON o_orderkey = "row" GROUP BY 1')
def layout_bytes(spark, d):
    size = [(r.shard_id, layout.byte_sizes(r.rows, r.nnz)) for r in shard_rollup(spark, d).collect()]  # a row for each shard
    return spark.createDataFrame([(i, b["csr"], b["coo"]) for i, b in size], "shard_id bigint, csr_bytes bigint, coo_bytes bigint")


@query("SELECT l_orderkey AS \"row\", l_partkey AS col, l_quantity AS value FROM lineitem WHERE l_orderkey < 0 OR l_partkey < 0 OR l_partkey >= (SELECT count(*) FROM part) OR l_orderkey >= (SELECT count(*) FROM orders)")
def bad_entries(spark, d):
    t = triplets(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_quantity", duplicates="keep")
    return validate.bad_entries(t, n_rows(spark, d), n_cols(spark, d))


@query(f'{WITH} SELECT col, count(*) AS nnz FROM (SELECT l_partkey AS col, l_discount FROM lineitem WHERE l_discount <> 0) GROUP BY 1')
def nonzero_discounts(spark, d):
    return reduce.row_counts(triplets(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_discount", duplicates="keep"), "col")


@query(r"""SELECT doc_id, CASE WHEN s = '' THEN 'source' ELSE s END AS label FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce('_' || source || ' (' || lang || ')', ''), '[^A-Za-z0-9_.-]', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)""")
def sanitized_labels(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.sanitize_label(F.concat(F.lit("_"), "source", F.lit(" ("), "lang", F.lit(")")), "source").alias("label"))


@query("SELECT c_custkey, (c_custkey * 2654435761) % 4294967296 AS mixed FROM customer")
def u32_products(spark, d):
    return read(spark, d, "customer").select("c_custkey", scalars.mul_u32(F.col("c_custkey"), F.lit(2654435761)).alias("mixed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x >= 65520 THEN 'inf'::FLOAT WHEN x = 0 THEN 0 ELSE (round_even(x / u, 0) * u)::FLOAT END AS half
FROM (SELECT *, pow(2, greatest(floor(log2(x)), -14) - 10) AS u FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::FLOAT::DOUBLE AS x FROM lineitem))""")
def half_precision(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.half("l_extendedprice").alias("half"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    from .streaming.append import windowed_counts

    return windowed_counts(read(spark, d, "events"), "ts", "event_type")


def _stored(spark, d, low: int = 0, high: int | None = None) -> SparseMatrix:
    """The rows low to high (or all from low on) as a matrix of shards of 2,500 rows, of two partitions each but for the last."""
    n = n_rows(spark, d)
    high = n if high is None else min(high, n)
    t = entries(spark, d).filter((F.col("row") >= low) & (F.col("row") < high)).withColumn("row", F.col("row") - low)
    obs = read(spark, d, "orders").filter(F.col("o_orderkey").between(low, high - 1)).select((F.col("o_orderkey") - low).alias("row"), F.col("o_orderpriority").alias("priority"))
    var = read(spark, d, "part").select(F.col("p_partkey").alias("col"), F.col("p_type").alias("id"))
    bounds = [0, *range(1250, high - low, 1250), high - low]
    return SparseMatrix(t, high - low, n_cols(spark, d), obs, var, tuple(bounds), tuple(bounds[:-1:2]) + (high - low,))


def _dataset(spark, d):
    from .sources import store

    return store.create(spark, _stored(spark, d), scratch_path(spark, "dataset"), {"source": "orders"})


@query(f'{WITH} SELECT "row", col, value FROM T')
def store_round_trip(spark, d):
    """Written as a dataset, opened again and read whole."""
    from .sources import store

    return store.open_dataset(spark, _dataset(spark, d).path).entries()


@query(f'{WITH} SELECT "row" - 2000 AS "row", col, value FROM T WHERE "row" >= 2000 AND "row" < 2700')
def store_row_range(spark, d):
    n = n_rows(spark, d)
    return _dataset(spark, d).read_range(min(n, 2000), max(0, min(700, n - 2000)))


@query('SELECT o_orderkey AS "row", o_orderpriority AS priority FROM orders')
def store_obs(spark, d):
    return _dataset(spark, d).obs


@query("SELECT p_partkey AS col, p_type AS id FROM part")
def store_var(spark, d):
    return _dataset(spark, d).var


@query(f'{WITH}, N AS (SELECT count(*) AS n FROM orders) SELECT "row", col, value, o_orderpriority AS priority FROM T JOIN orders ON o_orderkey = "row"')
def store_append(spark, d):
    """The first thousand rows as a dataset, the others appended in one generation, with a table that stays."""
    from .sources import store

    ds = store.create(spark, _stored(spark, d, 0, 1000), scratch_path(spark, "dataset"))
    ds = store.put_table(ds, "kept", spark.range(1))
    ds = store.append(ds, _stored(spark, d, 1000))
    if store.get_table(ds, "kept").count() != 1 or ds.nnz != ds.entries().count():
        raise AssertionError("the appended dataset isn't whole")
    return ds.entries().join(ds.obs, "row")


@query(f"""{WITH}, P AS (SELECT "row", (row_number() OVER (ORDER BY "row" DESC) - 1) AS new_row FROM (SELECT o_orderkey AS "row" FROM orders WHERE o_orderkey < 40)), C AS (SELECT col, (row_number() OVER (ORDER BY col DESC) - 1) AS new_col FROM V WHERE col % 2 = 1)
SELECT new_row AS "row", new_col AS col, value FROM T JOIN P USING ("row") JOIN C USING (col)""")
def store_derived(spark, d):
    """Forty rows and every other feature, both in falling order, as a dataset of their own."""
    from .sources import store

    ds = _dataset(spark, d)
    rows, features = [*range(min(40, ds.shape[0]))][::-1], [*range(1, ds.shape[1], 2)][::-1]
    return store.derive(ds, scratch_path(spark, "derived"), rows, features).entries()


@query(f'{WITH} SELECT "row", col, value FROM T WHERE "row" < 5000')
def pack_round_trip(spark, d):
    """The packs of the first two shards, written as sliced ELL and read back."""
    from .sources import packs

    ds, root = _dataset(spark, d), scratch_path(spark, "packs")
    shards = range(min(2, len(ds.meta["shards"]) - 1))
    packs.warm(ds, root, 0, len(shards))
    out = [packs.read_pack(ds, root, s).select("row", "col", "value") for s in shards]
    return out[0].unionByName(out[1]) if len(out) > 1 else out[0]


@query(f"""{WITH} SELECT 'orders' AS assay_id, "row" - 500 AS "row", col, value FROM T WHERE "row" >= 500 AND "row" < 900""")
def assay_range(spark, d):
    both = entries(spark, d).withColumn("assay_id", F.lit("orders")).unionByName(entries(spark, d).withColumn("assay_id", F.lit("other")))
    return align.assay_range(both, "orders", 500, 400, n_rows(spark, d)).select(F.lit("orders").alias("assay_id"), "row", "col", "value")


@query(f'{WITH}, N AS (SELECT count(*) // 2 AS n FROM orders) SELECT "row", col, value FROM T, N WHERE "row" >= n OR col >= 100')
def bad_entries(spark, d):
    """What lies outside a matrix of half as many rows and a hundred features."""
    return validate.bad_entries(entries(spark, d), n_rows(spark, d) // 2, 100).select("row", "col", "value")
