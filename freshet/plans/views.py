"""The general-purpose test tables seen as the shapes the operators take. Each is a plain projection or aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def daily(self) -> DataFrame:
        """Three dense series."""
        return self.lineitem.selectExpr("l_returnflag as station", "cast(l_shipdate as date) as date", "cast(l_quantity as double) as q").groupBy("station", "date").agg({"q": "sum"}).withColumnRenamed("sum(q)", "q")

    def sparse(self) -> DataFrame:
        """A gappy series per supplier."""
        return self.lineitem.selectExpr("cast(l_suppkey as string) as station", "cast(l_shipdate as date) as date", "cast(l_quantity as double) as q").groupBy("station", "date").agg({"q": "sum"}).withColumnRenamed("sum(q)", "q")

    def flagged(self) -> DataFrame:
        return self.daily().selectExpr("*", "case when q % 3 = 0 then 'B' end as symbol", "case when year(date) >= 2000 then 'provisional' else 'approved' end as status")

    def wide(self) -> DataFrame:
        days = self.daily().selectExpr("station", "year(date) as year", "month(date) as month", "concat('f', day(date)) as d", "q")
        return days.groupBy("station", "year", "month").pivot("d", [f"f{i}" for i in range(1, 32)]).agg({"q": "max"})

    def readings(self) -> DataFrame:
        return self.events.selectExpr("cast(user_id % 5 as string) as station", "cast(ts as timestamp) as ts", "value", "event_type in ('purchase', 'signup') as final", "cast(-8 + user_id % 5 as int) * 3600 as offset_s")

    def tree(self) -> DataFrame:
        own = self.customer.selectExpr(
            "c_custkey as id", "concat('100.', lpad(cast(c_nationkey % 5 + 1 as string), 6, '0'), '.', lpad(cast(c_nationkey + 1 as string), 6, '0')) as w", "c_custkey", "c_nationkey",
        ).selectExpr(
            "id", "w",
            "case when id % 97 = 0 then '100.000003.000005.000002' when id % 40 = 0 then w when id % 7 = 0 then concat(w, '.', lpad(cast(id % 40 as string), 6, '0'), '.000002') else concat(w, '.', lpad(cast(id % 40 as string), 6, '0')) end as l",
            "cast(id % 50 + 1 as double) as area", "case when id % 11 <> 0 then cast(id % 23 as double) end as v",
        )
        tops = self.region.selectExpr("1000000 + r_regionkey as id", "concat('100.', lpad(cast(r_regionkey + 1 as string), 6, '0')) as w", "concat('100.', lpad(cast(r_regionkey + 1 as string), 6, '0')) as l", "10.0D as area", "1.0D as v")
        low = self.region.selectExpr("2000000 + r_regionkey as id", "'100' as w", "concat('100.', lpad(cast(r_regionkey + 1 as string), 6, '0')) as l", "3.0D as area", "cast(null as double) as v")
        return own.unionByName(tops).unionByName(low)

    def monthly(self) -> DataFrame:
        return self.orders.join(self.customer, F.expr("o_custkey = c_custkey")).selectExpr("c_nationkey as id", "month(o_orderdate) as month", "o_totalprice as p").groupBy("id", "month").agg({"p": "avg"}).withColumnRenamed("avg(p)", "q")

    def sources(self) -> DataFrame:
        return self.lineitem.join(self.part, F.expr("l_partkey = p_partkey")).groupBy("l_partkey", "p_size").pivot("l_returnflag", ["A", "R"]).agg({"l_quantity": "sum"}).selectExpr("l_partkey as id", "cast(A as double) as routed", "cast(R as double) * (1 + l_partkey % 9) as balance", "p_size % 5 <> 0 as own_line")

    def yearly(self) -> DataFrame:
        """Yearly means per supplier."""
        return self.lineitem.selectExpr("cast(l_suppkey as string) as station", "year(l_shipdate) as year", "cast(l_quantity as double) as q").groupBy("station", "year").agg({"q": "avg"}).withColumnRenamed("avg(q)", "value")

    def bins(self) -> DataFrame:
        """Calendar bins of each nation: day means over years, one year in four has the leap day."""
        base = self.orders.join(self.customer, F.expr("o_custkey = c_custkey")).selectExpr("c_nationkey as subid", "month(o_orderdate) as month", "day(o_orderdate) as day", "o_totalprice as p").groupBy("subid", "month", "day").agg({"p": "avg"})
        return base.selectExpr("subid", "month", "day", "case when month = 2 and day = 29 then 7 else 30 end as n_days", "`avg(p)` / 1000 - 120 as q_local", "`avg(p)` / 100 as q_acc")

    def weights(self) -> DataFrame:
        n = self.nation.selectExpr("n_nationkey as k", "n_regionkey as r")
        up = n.alias("a").join(n.alias("b"), "r").where("b.k < a.k").groupBy("a.k").agg({"b.k": "collect_list"}).withColumnRenamed("collect_list(k)", "u")
        return n.join(up, "k", "left").selectExpr("k as segment", "k as subid", "0.25D + k % 4 / 4D as share", "coalesce(u, array()) as upstream_subids")

    def cells(self) -> DataFrame:
        return self.part.selectExpr("p_brand as polygon", "p_size as class", "cast(1 + p_partkey % 4 as double) / 4 as fraction", "case when p_partkey % 6 <> 0 then cast(p_partkey % 100 as double) end as value")
