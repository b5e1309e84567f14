"""What each layer of nested measurements costs by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def call_costs(calls: DataFrame, page: str = "page", place: str = "place", call: str = "call", cost: str = "cost", first: str = "sequential", counted: str = "per_view", most_first: int = 64) -> DataFrame:
    """(page, api_calls, api_calls_cached, api_cost, slowest_parallel): the critical path of a page's calls, which makes
    its ``first`` calls in a row and all later ones at once: the sum of those and the longest of these.

    Calls with a null cost, or not counted (null: counted), take no part, but those not counted are reported as
    cached. Order is by place, then name; of equally long parallel calls the one with the least name is named.
    ``first`` is a column, the same in all of a page's rows (null: 0); a value over ``most_first``, the number of calls
    that are ranked at all, is an error. A page's calls may be very many: ranking keeps no more than that of each
    task's, the rest is aggregated before the shuffle.
    """
    rows = calls.select(F.col(page).alias("page"), F.struct(F.col(place).alias("place"), F.col(call).alias("call")).alias("at"), F.col(cost).alias("cost"), F.coalesce(F.col(first), F.lit(0)).alias("first"), F.coalesce(F.col(counted), F.lit(True)).alias("counted"))
    rows = rows.withColumn("first", F.when(F.col("first") <= most_first, F.col("first")).otherwise(F.raise_error(F.lit("more first calls than are ranked"))))
    live = rows.filter("counted and cost is not null")
    order = W.partitionBy("page").orderBy("at")
    lead = live.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_first).filter("rank <= first")
    lead = lead.groupBy("page").agg(F.sum("cost").alias("lead"), F.max("at").alias("last"))
    rest = live.join(lead.select("page", "last"), "page", "left").filter("last is null or at > last")
    rest = rest.groupBy("page", "cost").agg(F.min("at.call").alias("call")).groupBy("page").agg(F.max(F.struct("cost", "call")).alias("longest"))
    counts = rows.groupBy("page").agg(F.count_if(F.expr("counted and cost is not null")).alias("api_calls"), F.count_if(F.expr("not counted")).alias("api_calls_cached"))
    both = counts.filter("api_calls > 0").join(lead, "page", "left").join(rest, "page", "left")
    cost = F.coalesce("lead", F.lit(0)) + F.coalesce("longest.cost", F.lit(0))
    return both.select("page", "api_calls", "api_calls_cached", cost.alias("api_cost"), F.col("longest.call").alias("slowest_parallel"))


def attribute_layers(measures: DataFrame, calls: DataFrame, layers: Sequence[str], keys: Sequence[str], page: str, digits: int = 1) -> DataFrame:
    """What each layer adds: for every step measured at the outermost layer its total at each layer, the difference to the
    next one in, and for the innermost what remains beside its page's calls (see ``call_costs``).

    ``measures`` has ``keys``, ``layer`` and ``total``, ``layers`` names the layers from the outside in; a step measured
    twice at a layer counts with its greatest total. Columns: keys, ``<layer>_total``, ``<layer>_own``, and the
    columns of ``call_costs``. A difference to a layer that was not measured is null.
    """
    totals = measures.groupBy(*keys).agg(*(F.max(F.when(F.col("layer") == x, F.col("total"))).alias(f"{x}_total") for x in layers))
    totals = totals.filter(F.col(f"{layers[0]}_total").isNotNull())
    paid = call_costs(calls).withColumnRenamed("page", "_page")
    rows = totals.join(paid, F.col(page) == F.col("_page"), "left")
    inner = [F.col(f"{x}_total") for x in layers[1:]] + [F.col("api_cost")]
    own = [F.round(F.col(f"{x}_total") - y, digits).alias(f"{x}_own") for x, y in zip(layers, inner, strict=True)]
    return rows.select(*keys, *(f"{x}_total" for x in layers), *own, "api_calls", "api_calls_cached", F.round("api_cost", digits).alias("api_cost"), "slowest_parallel")
