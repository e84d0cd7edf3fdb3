"""Nearest neighbours and AllKNN under-sampling (M26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours as N
from . import bindings as B
from .registry import query

FEATURES = ["NATION", "BALANCE", "REGION", "LOANS"]


def _rows(spark, d):
    """Labelled applicants with four integer features of like scale."""
    loans = B.loans(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    a = B.applicants(spark, d).where("TARGET is not null")
    return a.join(loans, a.c_custkey == loans.o_custkey, "left").select(
        "c_custkey", "TARGET", (F.col("c_nationkey") * 200).alias("NATION"), F.floor("c_acctbal").cast("int").alias("BALANCE"),
        (F.col("n_regionkey") * 500).alias("REGION"), (F.coalesce("n", F.lit(0)) * 100).cast("int").alias("LOANS"))


_SQL = dict(a=B.SQL_APPLICANTS, l=B.SQL_LOANS, r0="""SELECT c_custkey, TARGET, c_nationkey * 200 AS NATION,
  CAST(floor(c_acctbal) AS INTEGER) AS BALANCE, n_regionkey * 500 AS REGION, CAST(coalesce(n, 0) * 100 AS INTEGER) AS LOANS
  FROM a LEFT JOIN (SELECT o_custkey, count(*) AS n FROM l GROUP BY 1) ON o_custkey = c_custkey WHERE TARGET IS NOT NULL""")
_D2 = " + ".join(f"CAST(p.{c} - q.{c} AS DOUBLE) * (p.{c} - q.{c})" for c in FEATURES)


def _near(rows: str, k: int) -> str:
    return (f"SELECT p.c_custkey AS id, p.TARGET AS label, q.c_custkey AS near_id, q.TARGET AS near_label, {_D2} AS d2, "
            f"row_number() OVER (PARTITION BY p.c_custkey ORDER BY {_D2}, q.c_custkey) AS rank "
            f"FROM {rows} p JOIN {rows} q ON p.c_custkey <> q.c_custkey QUALIFY rank <= {k}")


@query("nearest_rows", B.with_ctes(f"SELECT id, CAST(rank AS INTEGER) AS rank, near_id, near_label, d2 FROM ({_near('r0', 3)})", **_SQL))
def nearest_rows(spark, d):
    """The three nearest applicants of each applicant."""
    near = N.nearest(_rows(spark, d), "c_custkey", "TARGET", FEATURES, 3)
    return near.select("id", F.posexplode("near").alias("rank", "c")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("c.id").alias("near_id"), F.col("c.label").alias("near_label"), "c.d2")


def _round(k: int) -> str:
    """Rows left after k neighbours; nothing more goes once the majority is the smaller class."""
    r = f"r{k - 1}"
    return (f"SELECT * FROM {r} WHERE (SELECT count(*) FILTER (WHERE TARGET = 0) < count(*) FILTER (WHERE TARGET <> 0) FROM {r}) "
            f"OR c_custkey NOT IN (SELECT id FROM ({_near(r, k)}) WHERE label = 0 AND near_label <> 0)") if k > 1 else (
            f"SELECT * FROM {r} WHERE c_custkey NOT IN (SELECT id FROM ({_near(r, k)}) WHERE label = 0 AND near_label <> 0)")


@query("allknn_undersample", B.with_ctes(f"SELECT c_custkey, TARGET, {', '.join(FEATURES)} FROM r3", **_SQL,
                                         r1=_round(1), r2=_round(2), r3=_round(3)))
def allknn_undersample(spark, d):
    """Applicants left after AllKNN with up to three neighbours."""
    return N.all_knn(_rows(spark, d), "c_custkey", "TARGET", FEATURES, 3)
