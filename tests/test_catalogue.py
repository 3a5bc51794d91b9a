"""Every registered query of the reference's operators against its SQL."""

import pytest

from compare import DATA, connection, rows
from effectum.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


LEARNERS = ("s_learner", "t_learner", "x_learner", "class_variable_transformation", "transformed_outcome", "propensity", "retrospective")
ESTIMATES = ("estimate_ate_bootstrap", "estimate_cate_per_quantile", "estimate_target_rate_per_quantile", "estimate_iroi_per_quantile", "estimate_cate_lift", "estimate_cum_iroi")


@pytest.mark.parametrize("name", [*LEARNERS, *ESTIMATES, "estimate_qini"])
def test_uplift_queries_read_all_line_items(spark, name):
    items = spark.read.parquet(f"{DATA}/lineitem.parquet")
    n, treated = items.count(), items.where("l_orderkey % 2 = 1").count()
    got = catalogue.queries()[name](spark, DATA)
    if name in LEARNERS:
        assert got.count() == n and got.where("cate_outcome is null").count() == 0
    elif name in ESTIMATES:
        rows_ = got.collect()
        cumulative = name in ("estimate_cate_lift", "estimate_cum_iroi")
        assert (max if cumulative else sum)(r["n_treated"] for r in rows_) == treated
        assert (max if cumulative else sum)(r["n_treated"] + r["n_control"] for r in rows_) == n
    else:
        means = {r["t"]: r["y"] for r in items.selectExpr("l_orderkey % 2 as t", "l_extendedprice as y").groupBy("t").avg("y").withColumnRenamed("avg(y)", "y").collect()}
        last = got.orderBy("fraction").collect()[-1]
        assert last["fraction"] == 1 and last["qini"] == pytest.approx(means[1] - means[0], rel=1e-6)


@pytest.mark.parametrize("name", ["boot_strap", "boot_strap_multi", "boot_strap_ols", "permutation"])
def test_resampling_queries_make_the_default_replicates(spark, name):
    assert catalogue.queries()[name](spark, DATA).select("replicate").distinct().count() >= 100


def test_aggregates_of_tied_prices_take_the_first_row(spark, tmp_path):
    """60,000 line items at 20 prices, as one file and as 7: the quantities at the extreme prices are those of the first rows, as in SQL on one thread. Nulls are among them."""
    import duckdb

    c = duckdb.connect()
    c.execute("set threads = 1")
    c.execute(f"create table t as select * replace (l_orderkey + i as l_orderkey, if((l_orderkey + i) % 997 = 0, null, l_quantity) as l_quantity, if((l_orderkey + i) % 13 = 0, null, l_partkey % 20)::double as l_extendedprice) from range(10) r(i), '{DATA}/lineitem.parquet'")
    n = c.execute("select count(*) from t").fetchone()[0]
    for files in (1, 7):
        folder = tmp_path / str(files) / "lineitem.parquet"
        folder.mkdir(parents=True)
        for i in range(files):
            c.execute(f"copy (select * from t where rowid * {files} // {n} = {i}) to '{folder}/part-{i}.parquet' (format parquet, row_group_size 4000)")
        c.execute(f"create or replace view lineitem as select * from read_parquet('{folder}/*.parquet')")
        assert rows(catalogue.queries()["aggregates"](spark, str(folder.parent)).toPandas()) == rows(c.execute(catalogue.oracle_sql()["aggregates"]).df())
