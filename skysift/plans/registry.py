"""Queries by name, with the SQL that says the same, over views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The views of ``Views``, in DuckDB's spelling.
_VIEWS = """
with recursive ev as (
  select event_id, value as detection_statistic, epoch_us(ts) / 1e6 as detection_time, user_id % 4 as slide,
         [0.0, (user_id % 4)::double] as shift, event_type, user_id from events
), tb as (select user_id % 4 as slide, 3600.0::double * count(distinct epoch_us(ts) // 3600000000) as tb from events group by 1
), veto as (
  select user_id % 2 as ifo, case when user_id % 3 = 0 then 'CAT1' when user_id % 3 = 1 then 'CAT2' else 'GATES' end as category,
         epoch_us(ts) / 1e6 - 60 - (props->>'k')::int as start, epoch_us(ts) / 1e6 + 60 + (props->>'k')::int as stop
  from events where event_type = 'error' and value > 100
), inj as (
  select event_id as inj_id, epoch_us(ts) / 1e6 as injection_time, user_id % 4 as slide, value as snr
  from events where event_type = 'purchase'
), series as (
  select s.slide::bigint as slide, i::bigint as i, coalesce(y, 0) as y from range(4) s(slide) cross join range(720) g(i)
  left join (select user_id % 4 as slide, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000 as i, max(value) as y
             from events group by all) using (slide, i)
), win as (
  select vec_id // 2 as block, case when vec_id % 2 = 0 then 'H1' else 'L1' end as ifo, embedding as samples, label from embeddings
), camp as (
  select 5 + 1.9 * l_quantity as mass_1, 5 + 1.9 * l_quantity * (0.2 + 10 * l_tax) * 0.9 as mass_2, l_discount as redshift,
         l_extendedprice / 1000 as detection_statistic, l_returnflag <> 'R' as recovered, l_suppkey % 2 as ifo from lineitem
), roc as (select doc_id, quality as y, (doc_id * 37 % 101) / 100.0 as score from labels
), states as (
  select epoch_us(ts) / 1e6 as t, user_id % 2 as ifo, event_type, event_id from events where event_type in ('error', 'signup')
), seg as (
  select o_orderkey, o_orderstatus as flag, epoch_us(o_orderdate) / 1e6 as start, epoch_us(o_orderdate) / 1e6 + o_totalprice as stop from orders
)
"""


class Views:
    """The driver's tables in the shapes that the operators work on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
        return self.table("events").withColumn("t", seconds).withColumn("slide", F.col("user_id") % 4)

    @cached_property
    def ev(self) -> DataFrame:
        return self.events.select(
            "event_id", F.col("value").alias("detection_statistic"), F.col("t").alias("detection_time"), "slide",
            F.array(F.lit(0.0), F.col("slide").cast("double")).alias("shift"), "event_type", "user_id",
        )

    @cached_property
    def tb(self) -> DataFrame:
        """The hours with events of each slide, in seconds."""
        hour = F.floor(F.col("t") / 3600)
        return self.events.groupBy("slide").agg((3600.0 * F.count_distinct(hour)).alias("tb"))

    @cached_property
    def veto(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.when(F.col("user_id") % 3 == 0, "CAT1").when(F.col("user_id") % 3 == 1, "CAT2").otherwise("GATES")
        return self.events.where("event_type = 'error' and value > 100").select(
            (F.col("user_id") % 2).alias("ifo"), kind.alias("category"), (F.col("t") - 60 - k).alias("start"), (F.col("t") + 60 + k).alias("stop")
        )

    @cached_property
    def inj(self) -> DataFrame:
        return self.events.where("event_type = 'purchase'").select(F.col("event_id").alias("inj_id"), F.col("t").alias("injection_time"), "slide", F.col("value").alias("snr"))

    @cached_property
    def series(self) -> DataFrame:
        hour = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 3600000000")
        loud = self.events.select("slide", hour.alias("i"), "value").groupBy("slide", "i").agg(F.max("value").alias("y"))
        grid = self.spark.range(4 * 720).select((F.col("id") % 4).alias("slide"), F.expr("id div 4").alias("i"))
        return grid.join(loud, ["slide", "i"], "left").select("slide", "i", F.coalesce("y", F.lit(0.0)).alias("y"))

    @cached_property
    def win(self) -> DataFrame:
        return self.table("embeddings").select(
            F.expr("vec_id div 2").alias("block"), F.when(F.col("vec_id") % 2 == 0, "H1").otherwise("L1").alias("ifo"), F.col("embedding").alias("samples"), "label"
        )

    @cached_property
    def camp(self) -> DataFrame:
        return self.table("lineitem").select(
            (5 + 1.9 * F.col("l_quantity")).alias("mass_1"), (5 + 1.9 * F.col("l_quantity") * (0.2 + 10 * F.col("l_tax")) * 0.9).alias("mass_2"),
            F.col("l_discount").alias("redshift"), (F.col("l_extendedprice") / 1000).alias("detection_statistic"),
            (F.col("l_returnflag") != "R").alias("recovered"), (F.col("l_suppkey") % 2).alias("ifo"),
        )

    @cached_property
    def roc(self) -> DataFrame:
        return self.table("labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("score"))

    @cached_property
    def states(self) -> DataFrame:
        return self.events.where("event_type in ('error', 'signup')").select("t", (F.col("user_id") % 2).alias("ifo"), "event_type", "event_id")

    @cached_property
    def seg(self) -> DataFrame:
        start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)
        return self.table("orders").select("o_orderkey", F.col("o_orderstatus").alias("flag"), start.alias("start"), (start + F.col("o_totalprice")).alias("stop"))


def query(name: str, sql: str | None = None):
    """Register a function of Views under a name, with DuckDB SQL that may use the views."""

    def put(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            text = sql.strip()
            SQL[name] = _VIEWS + (text if text.startswith(",") else text)
        return f

    return put
