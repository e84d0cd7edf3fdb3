"""Aggregation NULL rules, subsets, two-level weighting, holistic aggregates."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import agg as A
from ledgerlens.operators.rank import distributed_mode, exact_quantiles
from ledgerlens.plans import bindings as B


def _by_key(df, key="k"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0), (3, 1.0), (3, None), (3, 3.0)], "k int, x double")
    out = _by_key(A.agg_by(df, "k", [("x", ["sum", "mean", "var", "size", "count", "min"])]))
    assert [out[k]["x_SUM"] for k in (1, 2, 3)] == [0.0, 5.0, 4.0]
    assert [out[k]["x_MEAN"] for k in (1, 2, 3)] == [None, 5.0, 2.0]
    assert out[2]["x_VAR"] is None and out[3]["x_VAR"] == 2.0
    assert [out[k]["x_SIZE"] for k in (1, 2, 3)] == [2, 1, 3]
    assert [out[k]["x_COUNT"] for k in (1, 2, 3)] == [0, 1, 2]


def test_decimal_mean_is_exact(spark):
    df = spark.createDataFrame([(1, "0.10"), (1, "0.20"), (1, "0.30")], "k int, x string") \
        .select("k", F.col("x").cast("decimal(18,2)").alias("x"))
    out = A.agg_by(df, "k", [("x", ["sum", "mean"])]).first()
    assert out["x_SUM"] == 0.6 and out["x_MEAN"] == 0.6 / 3


def test_conditional_subsets(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "B", None), (2, "A", 3.0)], "k int, s string, x double")
    out = _by_key(A.conditional_agg(df, "k", [("x", ["sum", "mean", "size"])], "ALL_",
                                    {"B_": F.col("s") == "B"}))
    assert out[1]["B_x_SUM"] == 0.0      # subset rows exist, values all missing
    assert out[1]["B_x_SIZE"] == 1
    assert out[2]["B_x_SUM"] is None     # no subset row: absent after the left join
    assert out[2]["B_x_SIZE"] is None
    assert out[1]["ALL_x_SIZE"] == 2


def test_merge_specs_last_list_wins():
    spec = A.merge_specs({"a": ["nunique"], "b": ["max"]}, {"a": ["max", "mean"]})
    assert spec == [("a", ["max", "mean"]), ("b", ["max"])]


def test_two_level_weighted_equals_exploded(spark):
    rows = [(1, "a", 1.0)] * 3 + [(1, "b", 10.0), (2, "c", 2.0), (2, "c", None), (2, "d", None)]
    df = spark.createDataFrame(rows, "curr int, prev string, x double")
    out = _by_key(A.two_level_weighted_agg(df, "curr", "prev", [("x", ["sum", "mean"])],
                                           ["mean", "max", "min"], "P_", count_name="P_COUNT"), "curr")
    pdf = pd.DataFrame(rows, columns=["curr", "prev", "x"])
    lvl1 = pdf.groupby("prev").agg(s=("x", "sum"), m=("x", "mean"))
    exploded = pdf[["curr", "prev"]].merge(lvl1, left_on="prev", right_index=True)
    exp = exploded.groupby("curr").agg(s_mean=("s", "mean"), m_mean=("m", "mean"), s_max=("s", "max"))
    for c in (1, 2):
        assert abs(out[c]["P_P_x_SUM_MEAN"] - exp.loc[c, "s_mean"]) < 1e-12
        assert abs(out[c]["P_P_x_MEAN_MEAN"] - exp.loc[c, "m_mean"]) < 1e-12
        assert out[c]["P_P_x_SUM_MAX"] == exp.loc[c, "s_max"]
    assert out[1]["P_P_x_SUM_MEAN"] == 4.75   # row-weighted, not the plain 6.5
    assert out[1]["P_COUNT"] == 4


def test_exact_quantiles_distributed_match_numpy(spark):
    rng = np.random.default_rng(3)
    hot = rng.integers(0, 500, 3000).astype(float)       # one hot group with many values
    cold = rng.normal(size=40)
    rows = [(0, float(v)) for v in hot] + [(1, float(v)) for v in cold] + [(2, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    q = _by_key(exact_quantiles(df, "x", [0.001, 0.25, 0.5, 0.999], ["g"], buckets=7), "g")
    for g, vals in ((0, hot), (1, cold)):
        expect = np.percentile(vals, [0.1, 25, 50, 99.9])
        got = [q[g][f"q{i}"] for i in range(4)]
        assert np.allclose(got, expect, rtol=0, atol=1e-9), (g, got, expect)
    assert 2 not in q
    # same as Spark's own single-buffer percentile
    ref = df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()
    for r in ref:
        if r["m"] is not None:
            assert q[r["g"]]["q2"] == r["m"]


def test_median_in_spec_and_mode_ties(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (1, 2.0, "a"), (1, 2.0, "b"), (1, 1.0, "a"), (2, 7.0, None)],
                               "k int, x double, c string")
    out = _by_key(A.agg_by(df, "k", [("x", ["median", "max", "mode"]), ("c", ["mode"])]))
    assert out[1]["x_MEDIAN"] == 1.5 and out[1]["x_MODE"] == 1.0 and out[1]["c_MODE"] == "a"
    assert out[2]["c_MODE"] is None and out[2]["x_MEDIAN"] == 7.0
    m = _by_key(distributed_mode(df, ["k"], "c", "m"))
    assert m[1]["m"] == "a" and 2 not in m


def test_conditional_holistic_and_guard(spark):
    import pytest
    df = spark.createDataFrame([(1, "A", 1.0), (1, "A", 4.0), (1, "B", 9.0), (2, "B", 3.0)],
                               "k int, s string, x double")
    out = _by_key(A.conditional_agg(df, "k", [("x", ["median", "max"])], "ALL_",
                                    {"A_": F.col("s") == "A"}))
    assert out[1]["ALL_x_MEDIAN"] == 4.0 and out[1]["A_x_MEDIAN"] == 2.5
    assert out[2]["A_x_MEDIAN"] is None and out[2]["ALL_x_MAX"] == 3.0
    with pytest.raises(ValueError):
        A.agg_exprs([("x", ["median"])], "", df=df)


def test_multi_nunique_side_plan(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", None), (2, None, None)],
                               "k int, s string, x double")
    out = _by_key(A.agg_by(df, "k", [("s", ["nunique"]), ("x", ["nunique", "max"])]))
    assert (out[1]["s_NUNIQUE"], out[1]["x_NUNIQUE"], out[1]["x_MAX"]) == (2, 2, 2.0)
    assert (out[2]["s_NUNIQUE"], out[2]["x_NUNIQUE"]) == (0, 0)


def test_agg_through_parent_equals_join_then_aggregate(spark):
    lines = spark.createDataFrame([(10, 1.0, 2.0), (10, None, 1.0), (11, 3.0, 4.0), (12, 5.0, None)],
                                  "o int, x double, w double")
    owner = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "o int, c int")
    out = _by_key(A.agg_through_parent(lines, "o", owner, "c", {
        "m": ("mean", F.col("x")), "s": ("sum", F.col("x")), "n": ("count", F.col("x")),
        "hi": ("max", F.col("x")), "r": ("ratio", F.col("x") * F.col("w"), F.when(F.col("x").isNotNull(), F.col("w")))}), "c")
    assert out[1]["m"] == 2.0 and out[1]["s"] == 4.0 and out[1]["n"] == 2 and out[1]["hi"] == 3.0
    assert out[1]["r"] == (1.0 * 2.0 + 3.0 * 4.0) / (2.0 + 4.0)
    assert out[2]["m"] == 5.0 and out[2]["r"] is None


def test_spec_through_parent_equals_join_then_agg_by(spark):
    lines = spark.createDataFrame([(10, "1.50", 2), (10, "2.25", None), (11, "3.00", 5), (12, None, 7), (12, "4.10", 1)],
                                  "o int, a string, k int").select("o", F.col("a").cast("decimal(18,2)").alias("a"), "k")
    owner = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "o int, c int")
    spec = [("a", ["sum", "mean", "min", "max", "count"]), ("k", ["var", "std", "size", "mean"])]
    via = _by_key(A.agg_spec_through_parent(lines, "o", owner, "c", spec, "P_"), "c")
    direct = _by_key(A.agg_by(lines.join(owner, "o"), "c", spec, "P_"), "c")
    for c in (1, 2):
        for k, v in direct[c].items():
            w = via[c][k]
            assert (v is None and w is None) or abs(v - w) < 1e-9, (c, k, v, w)


def test_variance_through_parent_keeps_its_digits(spark):
    rows = [(i % 5, i, 1e9 + 0.001 * (i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "mid int, id int, x double")
    parent = spark.createDataFrame([(m, 0) for m in range(5)], "mid int, root int")
    got = A.agg_spec_through_parent(df, "mid", parent, "root", [("x", ["var", "std", "mean", "count"])]).first()
    want = df.selectExpr("var_samp(x) v").first().v
    assert got.x_VAR == pytest.approx(want, rel=1e-4) and got.x_STD == pytest.approx(want ** 0.5, rel=1e-4)
    assert got.x_COUNT == 30


def test_distinct_count_does_not_depend_on_other_columns(spark):
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, "b"), (1, None, "a")], "k int, x double, y string")
    one = A.agg_by(df, "k", [("x", ["nunique"])]).first()
    two = A.agg_by(df, "k", [("x", ["nunique"]), ("y", ["nunique"])]).first()
    assert one.x_NUNIQUE == two.x_NUNIQUE == 1 and two.y_NUNIQUE == 2


def test_wide_decimals_are_exact_and_do_not_overflow(spark):
    rows = [(1, Decimal("1234567890123456.78")), (1, Decimal("0.01"))] + [(2, Decimal("9999999999999999.00"))] * 12
    df = spark.createDataFrame(rows, "k int, x decimal(18,2)")
    exprs = A.agg_exprs([("x", ["sum"])], df=df, keep_decimal=True)
    got = {r.k: r.x_SUM for r in df.groupBy("k").agg(*exprs).collect()}
    assert got == {1: Decimal("1234567890123456.79"), 2: Decimal("119999999999999988.00")}
    small = spark.createDataFrame([(1, Decimal("9999999999.99"))] * 12, "k int, x decimal(12,2)")
    assert A.agg_by(small, "k", [("x", ["sum", "mean"])]).first().x_SUM == pytest.approx(119999999999.88, abs=1e-3)


def test_applicants_of_unknown_nations_stay(spark, tmp_path):
    spark.createDataFrame([(1, "a", 0, 5.0, "BUILDING"), (2, "b", 99, -5.0, "X")],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string") \
        .write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "N", 3)], "n_nationkey int, n_name string, n_regionkey int") \
        .write.parquet(str(tmp_path / "nation.parquet"))
    got = {r.c_custkey: r.n_name for r in B.applicants(spark, str(tmp_path)).collect()}
    assert got == {1: "N", 2: None}


DISTINCT_ROWS = [(10, "a", 1.0, "N"), (10, "a", 2.0, "R"), (11, "b", 2.0, "N"), (11, None, 0.0, None), (12, "a", -0.0, "N"),
                 (13, None, None, None), (14, "c", 9.0, "A"), (None, "z", 7.0, "R"), (99, "q", 3.0, "N")]
DISTINCT_SCHEMA = "o int, s string, x double, f string"


def test_distinct_through_parent_equals_join_then_count(spark):
    lines = spark.createDataFrame(DISTINCT_ROWS, DISTINCT_SCHEMA)
    owner = spark.createDataFrame([(10, 1), (11, 1), (12, 1), (13, 2), (14, None), (15, 3)], "o int, c int")
    mid = A.MidPass(lines, "o").direct([("x", ["max", "size"])]).distinct(["s", "x", "f"], "P_", levels={"f": ["A", "N", "R"]})
    via = _by_key(mid.run(owner, "c", extra=[F.count(F.lit(1)).alias("loans")]), "c")
    joined = lines.join(owner, "o").groupBy("c").agg(*[F.countDistinct(c).alias(f"P_{c}_NUNIQUE") for c in "sxf"])
    for c, want in _by_key(joined, "c").items():
        assert {k: via[c][k] for k in want} == want
    assert set(via) == {1, 2, None} and via[1]["P_x_NUNIQUE"] == 3 and via[2]["P_f_NUNIQUE"] == 0
    left = _by_key(mid.run(owner, "c", how="left"), "c")
    assert left[3]["P_s_NUNIQUE"] is None and left[2]["P_s_NUNIQUE"] == 0 and left[None]["P_s_NUNIQUE"] == 1


def test_distinct_through_parent_plan_and_refusals(spark):
    lines = spark.createDataFrame(DISTINCT_ROWS, DISTINCT_SCHEMA)
    owner = spark.createDataFrame([(10, 1), (14, 1)], "o int, c int")
    plan = A.MidPass(lines, "o").distinct(["s", "x"]).run(owner, "c")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    with pytest.raises(ValueError):
        A.MidPass(lines, "o").distinct(["s"], levels={"s": list(range(64))})
    with pytest.raises(ValueError):
        A.MidPass(lines.select("o", F.array("s").alias("a")), "o").distinct(["a"])
    with pytest.raises(Exception, match="no level of f: A"):
        A.MidPass(lines, "o").distinct(["f"], levels={"f": ["N", "R"]}).run(owner, "c").collect()
    with_61 = [*range(61), "a", "b"]
    got = A.MidPass(lines, "o").distinct(["s"], levels={"s": [str(v) for v in with_61] }).run(
        owner.where("o = 10"), "c").first()
    assert got["s_NUNIQUE"] == 1


def _exchange_widths(df):
    """Columns of the rows that each shuffle of the first plan moves."""
    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        own = [node.output().size()] if node.nodeName() == "Exchange" else []
        return own + [w for i in range(node.children().size()) for w in walk(node.children().apply(i))]
    return walk(df._jdf.queryExecution().executedPlan())


def test_mart_shuffles_rows_not_states(spark):
    """The mart's blocks have hundreds of states; the shuffles carry the lines, the loans and one row per loan."""
    from ledgerlens.operators.encode import OneHotModel
    from ledgerlens.plans import mart as M
    loans = spark.sql("""select * from values (1L, 7L, 'F', 'a', 10.5, -3), (2L, 7L, 'O', 'b', 2.0, -9), (3L, 8L, 'O', 'a', 1.0, -1),
                         (3L, 9L, 'F', 'a', 4.0, -2), (null, 9L, 'F', 'a', 1.0, -1)
                         t(o_orderkey, o_custkey, o_orderstatus, o_orderpriority, p, DAYS_DECISION)""") \
        .select("*", F.col("p").cast("decimal(12,2)").alias("AMT_PRICE")).drop("p")
    lines = spark.sql("""select * from values (1L, 1, 5.0D, 30.25, 0.05D, 0.01D, 'R', 'F', -400), (1L, 2, 7.0D, 10, 0.0D, null, 'N', 'O', -100),
                         (3L, 1, 1.0D, 99.99, 0.1D, 0.02D, 'A', 'F', 5), (null, 1, 1.0D, 1, 0.1D, 0.1D, 'A', 'F', 5)
                         t(l_orderkey, l_linenumber, l_quantity, p, l_discount, l_tax, l_returnflag, l_linestatus, DAYS_SHIP)""") \
        .select("*", F.col("p").cast("decimal(12,2)").alias("AMT_EXT"), (-F.col("l_linenumber")).alias("MONTHS_BALANCE")).drop("p")
    model = M.fit(loans, lines, lines.select(F.col("l_returnflag").alias("event_type")))
    out = M.loan_and_line_features(loans, lines, model)
    assert max(_exchange_widths(out)) < 100
    got = {r[M.KEY]: r for r in out.collect()}
    assert set(got) == {7, 8, 9}
    assert (got[7].PREV_COUNT, got[7].POS_COUNT, got[7].INSTAL_AMT_EXT_SUM, got[7].CC_AMT_EXT_MAX) == (2, 2, 40.25, 30.25)
    assert (got[7].CC_l_tax_MEAN, got[7].INSTAL_DPD_MAX, got[7].POS_POS_l_quantity_SUM_MEAN) == (0.01, 500, 12.0)
    assert (got[8].CC_AMT_EXT_SUM, got[9].CC_AMT_EXT_SUM, got[9].PREV_COUNT) == (99.99, 99.99, 2)
