"""Scans and sinks (S*)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import agg as A
from ..session import scratch_path
from ..sources import io as IO
from . import bindings as B
from .q_agg import PREV_SPEC, sql_spec
from .registry import query

W = B.with_ctes
H = "('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT"


@query("scan_table", "SELECT * FROM customer")
def scan_table(spark, d):
    return IO.scan_table(spark, d, "customer")


@query("scan_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def scan_limit(spark, d):
    return IO.scan_limit(IO.scan_table(spark, d, "orders"), 100, ["o_orderkey"])


@query("sink_roundtrip", W(f"SELECT o_custkey, {sql_spec(PREV_SPEC, 'PREV_', ['AMT_PRICE'])} FROM l GROUP BY o_custkey",
                           l=B.SQL_LOANS))
def sink_roundtrip(spark, d):
    agg = A.agg_by(B.loans(spark, d), "o_custkey", PREV_SPEC, "PREV_")
    return IO.sink_roundtrip(spark, agg, "prev_mart", bucket_key="o_custkey")


MART_BUCKETS = 8
ACTIVITY_SPEC = [("AMT_VALUE", ["max", "mean", "sum"]), ("event_id", ["size"])]


def store_marts(spark, d, buckets=MART_BUCKETS):
    """Root, loan and activity marts, each stored by applicant; their paths."""
    key = "c_custkey"
    loans = A.agg_by(B.loans(spark, d), "o_custkey", PREV_SPEC, "PREV_").withColumnRenamed("o_custkey", key)
    activity = A.agg_by(B.activity(spark, d), key, ACTIVITY_SPEC, "EVT_")
    root = B.applicants(spark, d).select(key, "TARGET", "n_name")
    return [IO.save_mart(df, scratch_path(spark, f"{n}_mart"), key, buckets)
            for n, df in (("root", root), ("loan", loans), ("activity", activity))]


@query("stored_marts_join", W(f"""SELECT a.c_custkey, TARGET, n_name, p.* EXCLUDE (c_custkey), e.* EXCLUDE (c_custkey) FROM a
LEFT JOIN (SELECT o_custkey AS c_custkey, {sql_spec(PREV_SPEC, 'PREV_', ['AMT_PRICE'])} FROM l GROUP BY 1) p ON p.c_custkey = a.c_custkey
LEFT JOIN (SELECT c_custkey, {sql_spec(ACTIVITY_SPEC, 'EVT_', ['AMT_VALUE'])} FROM v GROUP BY 1) e ON e.c_custkey = a.c_custkey""",
                              a=B.SQL_APPLICANTS, l=B.SQL_LOANS, v=B.SQL_ACTIVITY))
def stored_marts_join(spark, d):
    root, *marts = [IO.open_mart(spark, p) for p in store_marts(spark, d)]
    return IO.join_marts(root, marts, "c_custkey")


@query("submission_frame", W("""SELECT CAST(c_custkey AS BIGINT) AS SK_ID_CURR, round(ET, 8) AS TARGET
FROM s WHERE TARGET IS NULL""", s=B.SQL_SCORES))
def submission_frame(spark, d):
    s = B.model_scores(spark, d).where("TARGET IS NULL")
    return IO.submission_frame(s, "c_custkey", "ET", 8, id_name="SK_ID_CURR", score_name="TARGET")


VEC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("parse_vector_line", f"""SELECT l_orderkey, l_linenumber, CAST(position AS INTEGER) AS position,
CAST(trim(tok) AS DOUBLE) AS weight FROM (
  SELECT l_orderkey, l_linenumber, unnest(range(len(arr))) AS position, unnest(arr) AS tok FROM (
    SELECT l_orderkey, l_linenumber, string_split(concat_ws(',', {', '.join(f'CAST({c} AS VARCHAR)' for c in VEC_COLS)}), ',') AS arr
    FROM lineitem))""")
def parse_vector_line(spark, d):
    li = IO.scan_table(spark, d, "lineitem")
    # one comma-joined line of weights per balance line (no grouping needed)
    line = li.select("l_orderkey", "l_linenumber",
                     F.concat_ws(",", *[F.col(c).cast("string") for c in VEC_COLS]).alias("value"))
    return IO.parse_vector_line(line, "value", key_cols=["l_orderkey", "l_linenumber"])


@query("sample_rows", f"SELECT * FROM customer ORDER BY {H}, c_custkey LIMIT 50")
def sample_rows(spark, d):
    return IO.sample_rows(IO.scan_table(spark, d, "customer"), 50, "c_custkey")


PROFILE_TABLES = ["customer", "orders", "lineitem", "events", "nation"]


@query("table_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INTEGER) AS n_cols FROM {t}"
    for t in PROFILE_TABLES))
def table_profile(spark, d):
    return IO.table_profile({t: IO.scan_table(spark, d, t) for t in PROFILE_TABLES})


@query("multi_file_scan", """SELECT 'customer.parquet' AS file_name, count(*) AS n_rows, round(sum(c_acctbal), 2) AS total_balance FROM customer
UNION ALL SELECT 'supplier.parquet' AS file_name, count(*) AS n_rows, round(sum(s_acctbal), 2) AS total_balance FROM supplier""")
def multi_file_scan(spark, d):
    paths = [os.path.join(d, f"{t}.parquet") for t in ("customer", "supplier")]
    df = IO.multi_file_scan(spark, paths, ["c_acctbal", "s_acctbal"])
    return df.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum(F.coalesce("c_acctbal", "s_acctbal")), 2).alias("total_balance"))


# --------------------------------------------------------------- CSV files ---
# written to the shared folder from a given table, then scanned as a file

CSV_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CSV_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CSV_SQL = """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment
FROM customer"""


@query("csv_keyed_scan", CSV_SQL)
def csv_keyed_scan(spark, d):
    path = IO.write_csv(IO.scan_table(spark, d, "customer").select(*CSV_COLS), scratch_path(spark, "customer.csv"))
    return IO.csv_scan(spark, path, CSV_SCHEMA)


@query("csv_headerless_scan", CSV_SQL)
def csv_headerless_scan(spark, d):
    path = IO.write_csv(IO.scan_table(spark, d, "customer").select(*CSV_COLS), scratch_path(spark, "customer.csv"), header=False)
    return IO.csv_scan(spark, path, CSV_SCHEMA, header=False)


@query("csv_glob_scan", W(" UNION ALL ".join(
    f"SELECT '{n}.csv' AS file_name, CAST(c_custkey AS BIGINT) AS c_custkey, {n} AS score FROM s" for n in B.SCORE_NAMES),
    s=B.SQL_SCORES))
def csv_glob_scan(spark, d):
    """The score files of all models, one file name per model, in one scan."""
    scores, base = B.model_scores(spark, d), scratch_path(spark, "scores")
    for n in B.SCORE_NAMES:
        IO.write_csv(scores.select("c_custkey", F.col(n).alias("score")), f"{base}/{n}.csv")
    return IO.csv_glob(spark, f"{base}/*.csv", "c_custkey bigint, score double")


@query("submission_csv", W("""SELECT CAST(c_custkey AS BIGINT) AS SK_ID_CURR, round(ET, 8) AS TARGET
FROM s WHERE TARGET IS NULL""", s=B.SQL_SCORES))
def submission_csv(spark, d):
    s = B.model_scores(spark, d).where("TARGET IS NULL")
    frame = IO.submission_frame(s, "c_custkey", "ET", 8, id_name="SK_ID_CURR", score_name="TARGET")
    return IO.csv_scan(spark, IO.write_submission(frame, scratch_path(spark, "submission.csv")), "SK_ID_CURR bigint, TARGET double")


@query("stored_importance_scan", f"""SELECT feature, round(avg(importance), 8) AS mean_importance, count(*) AS n_folds
FROM ({B.sql_importance_long()}) GROUP BY feature""")
def stored_importance_scan(spark, d):
    """A per-fold importance table, stored as CSV and scanned back (features of no importance left out)."""
    path = IO.write_csv(B.importance_long(spark, d), scratch_path(spark, "importances.csv"))
    stored = IO.csv_scan(spark, path, "feature string, fold int, importance double")
    return stored.where("importance > 0").groupBy("feature").agg(F.round(F.avg("importance"), 8).alias("mean_importance"),
                                         F.count(F.lit(1)).alias("n_folds"))
