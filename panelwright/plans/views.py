"""Panels over the star-schema tables that the registered queries work on, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy tables and panels of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def panel_nation(self) -> DataFrame:
        rows = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("period"))
        counted = rows.agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("o_custkey").alias("denom"))
        return counted.join(self.nation, F.col("entity") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("grp"), "entity", "period", "cases", "denom")

    def panel_supplier(self) -> DataFrame:
        rows = self.lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("period"))
        counted = rows.agg(F.count(F.lit(1)).alias("cases"), F.sum("l_quantity").alias("denom"))
        return counted.join(self.supplier, F.col("entity") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("grp"), "entity", "period", "cases", "denom")

    def panel_gappy(self) -> DataFrame:
        return self.panel_supplier().filter((F.col("entity") + F.col("period")) % 4 != 0)

    def rates(self) -> DataFrame:
        return self.panel_gappy().withColumn("rate", F.round(F.col("cases") / F.col("denom") * 1000, 6))

    def daily_supplier(self, lines: DataFrame | None = None) -> DataFrame:
        return (self.lineitem if lines is None else lines).groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))

    def obs_eav(self) -> DataFrame:
        return self.events.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("d"), F.col("event_type").alias("datatype")).agg(F.round(F.sum("value"), 4).alias("value"))

    def season(self) -> DataFrame:
        return self.orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("period")).agg(F.count(F.lit(1)).alias("cases"))

    def multi_source(self) -> DataFrame:
        rows = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return rows.groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("total"))

    def points(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.customer.select(key.alias("entity"), (F.lit(30.0) + key * 37 % 1801 / 100.0).alias("lat"), (F.lit(-110.0) + key * 101 % 3607 / 100.0).alias("lon"))


#: The same views for DuckDB, put before a query's own text.
SQL = {
    "panel_nation": """SELECT n_regionkey AS grp, c_nationkey AS entity, year(o_orderdate)::INT AS period, count(*) AS cases, count(DISTINCT o_custkey) AS denom
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "panel_supplier": """SELECT s_nationkey AS grp, l_suppkey AS entity, year(l_shipdate)::INT AS period, count(*) AS cases, sum(l_quantity) AS denom
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    "panel_gappy": "SELECT * FROM panel_supplier WHERE (entity + period) % 4 <> 0",
    "rates": "SELECT *, round(cases / denom * 1000, 6) AS rate FROM panel_gappy",
    "daily_supplier": "SELECT l_suppkey AS entity, l_shipdate::DATE AS d, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "obs_eav": "SELECT user_id AS entity, ts::DATE AS d, event_type AS datatype, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3",
    "season": "SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS period, count(*) AS cases FROM orders GROUP BY 1, 2",
    "multi_source": """SELECT c_nationkey AS entity, year(o_orderdate)::INT AS period, o_orderpriority AS source, count(*) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "points": "SELECT c_custkey AS entity, 30.0::DOUBLE + c_custkey * 37 % 1801 / 100.0::DOUBLE AS lat, -110.0::DOUBLE + c_custkey * 101 % 3607 / 100.0::DOUBLE AS lon FROM customer",
}


def with_views(body: str, *views: str) -> str:
    """body with the named views (and those they need) as common tables; body may itself begin with WITH."""
    needs = {"panel_gappy": ["panel_supplier"], "rates": ["panel_supplier", "panel_gappy"]}
    names = list(dict.fromkeys(n for v in views for n in [*needs.get(v, []), v]))
    own = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {own}, {body[5:]}"
    return f"WITH {own} {body}"
