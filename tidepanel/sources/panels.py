"""Monthly panels aggregated from raw fact tables.

Grouping by (group, month) makes the panel key unique. Only the columns a panel
needs are read, and the aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import month_start
from tidepanel.spec import PanelSpec

SUPPLIER = PanelSpec(date="date", target="y", group="grp", components=("vol", "invol"))
NATION = PanelSpec(date="date", target="y", group="grp", components=())


def _percent(condition: Column) -> Column:
    return 100.0 * F.sum(F.when(condition, 1).otherwise(0)) / F.count(F.lit(1))


def returns_panel(lineitem: DataFrame, group: str) -> DataFrame:
    """Monthly return rate per ``group`` (a line item column) with its two parts.

    ``admissions`` counts distinct orders exactly; it is dropped from the plan,
    with its extra shuffle, wherever a query does not use it.
    """
    returned = F.col("l_returnflag") == "R"
    return lineitem.groupBy(
        F.col(group).alias("grp"), month_start(F.col("l_shipdate")).alias("date")
    ).agg(
        _percent(returned).alias("y"),
        F.count(F.lit(1)).alias("headcount"),
        F.count_distinct("l_orderkey").alias("admissions"),
        _percent(returned & (F.col("l_linestatus") == "O")).alias("vol"),
        _percent(returned & (F.col("l_linestatus") == "F")).alias("invol"),
    )


def supplier_panel(lineitem: DataFrame) -> DataFrame:
    return returns_panel(lineitem, "l_suppkey")


def nation_panel(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Monthly share of finished orders per nation.

    Orders are counted per (customer, month) before the joins. That shrinks a
    customer with very many orders to one row a month, and turns the distinct
    customers of a nation's month into a plain count.
    """
    per_customer = orders.groupBy("o_custkey", month_start(F.col("o_orderdate")).alias("date")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"),
    )
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("grp"), "date")
        .agg(
            (100.0 * F.sum("finished") / F.sum("orders")).alias("y"),
            F.count(F.lit(1)).alias("headcount"),
            F.sum("orders").alias("admissions"),
        )
    )
