"""Shape of the physical plans."""

from kledger.operators import store as S
from kledger.plans import QUERIES
from kledger.plans import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark, sf):
    for name in ("RET-03", "RET-04", "JN-09", "VER-05", "CON-06", "ING-05", "AG-09"):
        p = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in p, name


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(QUERIES["WN-15"](spark, sf))
    assert "WindowGroupLimit" in plan(QUERIES["TK-08"](spark, sf))


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark.read.parquet(f"{sf}/conversations.parquet").filter("turn > 2").groupBy("role").count())
    assert "PushedFilters: [IsNotNull(turn), GreaterThan(turn,2)]" in p and "text" not in p.split("ReadSchema")[1].split("\n")[0]


def test_folds_combine_on_the_map_side(spark, sf):
    p = plan(S.fold_jobs(fx.job_log(spark, sf), ["ledger", "job_id"]))
    assert "partial_max_by" in p
