"""The frame, sources and sinks, the SQL front end and streams."""

import os

import pytest
from pyspark.sql import functions as F

from compare import DATA
from effectum.frame import Frame
from effectum.plans.sql import parse_call, plan, sql, tokens
from effectum.sources import tables
from effectum.streaming import windows


@pytest.fixture(scope="module")
def orders(spark):
    spark.read.parquet(f"{DATA}/orders.parquet").createOrReplaceTempView("orders")
    return Frame(spark.table("orders"))


def test_frame_steps(orders):
    assert orders.count() == orders.df.count()
    by = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    assert by.where("n > 0").df.count() == by.df.count()
    assert orders.agg({"o_totalprice": "max"}) == orders.max("o_totalprice")
    assert isinstance(orders.groupBy("o_orderstatus").avg("o_totalprice"), Frame)
    assert orders.brief()["columns"] == len(orders.columns())
    with pytest.raises(ValueError):
        orders.drop("nothing")
    with pytest.raises(ValueError):
        orders.union(orders.select("o_orderkey"))
    with pytest.raises(ValueError):
        orders.join(orders, "o_orderkey", type="sideways")
    same = orders.join(orders.select("o_orderkey", "o_totalprice * 2 as twice"), "o_orderkey")
    assert same.columns() == [*orders.columns(), "twice"]
    assert orders.quantile("o_totalprice", 0.5, exact=True) is not None
    assert "Aggregate" in by.getExecutedSql()


def test_methods_reach_the_operators(orders):
    assert orders.ttest_2samp("avg(o_totalprice)", "o_custkey % 2").df.count() == 1
    assert orders.groupBy("o_orderstatus").delta_method("avg(o_totalprice)", std=True).df.count() == 3
    assert orders.ols("o_totalprice ~ o_custkey").df.count() == 2
    assert orders.describe(["o_totalprice"]).df.count() == 1


def test_csv_and_tables(spark, orders, tmp_path):
    orders.head(10).toCsv(str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"))
    assert back.count() == 10 and back.columns == orders.columns()
    tables.drop_table(spark, "effectum_t")
    tables.write_table(orders.df.limit(5), "effectum_t", replace=True)
    assert tables.row_count(spark, "effectum_t") == 5 and "effectum_t" in tables.show_tables(spark)
    tables.insert_table(orders.df.limit(3), "effectum_t")
    assert tables.row_count(spark, "effectum_t") == 8
    assert tables.table_meta(spark, "effectum_t").count() >= 6 and "effectum_t" in tables.show_create(spark, "effectum_t")
    tables.drop_table(spark, "effectum_t")
    tables.drop_table(spark, "effectum_p")
    tables.create_table(spark, "effectum_p", "a int, d string", partition_by=["d"])
    spark.sql("insert into effectum_p values (1, 'x'), (2, 'y')")
    tables.drop_partition(spark, "effectum_p", d="x")
    assert tables.row_count(spark, "effectum_p") == 1
    tables.drop_table(spark, "effectum_p")
    filled = tables.read_spark(spark.createDataFrame([(None, None), ("a", 1.0)], "s string, v double"))
    assert filled.first()["s"] == "-1" and filled.first()["v"] == 0


def test_parse_call():
    c = parse_call(tokens("ttest_2samp(avg(a) / avg(b), t % 2, 'less', x=avg(c) + avg(d)) as r"))
    assert c.name == "ttest_2samp" and c.args == ["avg(a) / avg(b)", "t % 2", "'less'"] and c.named == {"x": "avg(c) + avg(d)"}
    assert parse_call(tokens("count(*)")) is None
    assert parse_call(tokens("ols(y ~ x), 1")) is None
    assert parse_call(tokens("ols(y ~ x /* a, comment) */)")).args == ["y ~ x"]


def test_sql_front_end(spark, orders):
    assert plan(spark, "select o_orderkey from orders") is None
    assert sql(spark, "select count(*) as n from orders").first()["n"] == orders.count()
    r = sql(spark, "with q as (select * from orders where o_totalprice > 10) select ttest_2samp(avg(o_totalprice), o_custkey % 2, 'two-sided') from q where o_orderkey > 3 group by o_orderstatus")
    assert r.columns[0] == "o_orderstatus" and r.count() == 3
    with pytest.raises(ValueError):
        sql(spark, "select quantileTestBucket(o_totalprice, o_custkey % 2, [0.5], o_orderkey) from orders group by o_orderstatus")
    for text in ("deltamethod(avg(o_totalprice), false)", "ttest_1samp(avg(o_totalprice), 'greater', 10)", "srm(1, o_custkey % 2, [1, 1])", "ols(o_totalprice ~ o_custkey - 1)", "cutbins(o_totalprice, [1, 2], false)", "mannWhitneyUTest(o_totalprice, o_custkey % 2, 'less')", "exactMatching(o_custkey % 2, o_orderstatus, order=o_orderkey)", "bootStrap('avg(o_totalprice)', 1, 5, key=o_orderkey)", "predict(ols(o_totalprice ~ o_custkey), 'prediction', 0.9)"):
        assert sql(spark, f"select {text} from orders").count() > 0, text


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    aggs = [F.count("*").alias("n")]
    got = windows.run_available(windows.windowed(stream, "ts", ["event_type"], aggs, "1 hour"), "effectum_stream", "complete")
    want = windows.windowed(events, "ts", ["event_type"], aggs, "1 hour")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_rows_are_left_out(spark, tmp_path):
    for i, t in enumerate(("2024-01-01 00:00:00", "2024-01-01 10:00:00", "2024-01-01 11:30:00", "2024-01-01 00:30:00", "2024-01-02 00:00:00")):
        spark.sql(f"select timestamp '{t}' as ts, 'a' as k").write.mode("append").parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").iterdir():  # files are read in the order of their times
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    out = windows.run_available(windows.windowed(stream, "ts", ["k"], [F.count("*").alias("n")], "1 hour", delay="1 hour"), "effectum_late")
    assert all(r["n"] == 1 for r in out.collect())
