"""The monthly product metrics written in Spark SQL over temp views.

Same plan as `metrics.monthly_product_metrics` (Catalyst produces the same
operators either way); parameters are bound with named parameter markers
instead of a one-row parameter CTE joined to every scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketlens.params import Params
from basketlens.sources.tables import Tables

MONTHLY_PRODUCT_METRICS = """
WITH sales AS (
  SELECT trunc(to_date(created_at), 'MM') AS month,
         SUM(sale_price) AS revenue_exact,
         COUNT(DISTINCT order_id) AS orders,
         COUNT(id) AS units
  FROM {prefix}order_items
  WHERE status = :status AND returned_at IS NULL
    AND to_date(created_at) BETWEEN :start_date AND :end_date
  GROUP BY 1
),
user_flags AS (
  SELECT trunc(to_date(created_at), 'MM') AS month,
         user_id,
         bool_or(event_type = :top_event) AS top,
         bool_or(event_type = :conversion_event) AS conv
  FROM {prefix}events
  WHERE to_date(created_at) BETWEEN :start_date AND :end_date
  GROUP BY 1, 2
),
funnel AS (
  SELECT month,
         count_if(user_id IS NOT NULL AND top) AS top_funnel_users,
         count_if(user_id IS NOT NULL AND conv) AS converted_users
  FROM user_flags
  GROUP BY 1
)
SELECT s.month,
       CAST(s.revenue_exact AS DOUBLE) AS revenue,
       s.orders,
       s.units,
       try_divide(CAST(s.revenue_exact AS DOUBLE), CAST(s.orders AS DOUBLE)) AS aov,
       try_divide(CAST(f.converted_users AS DOUBLE), CAST(f.top_funnel_users AS DOUBLE)) AS monthly_conversion_rate
FROM sales s
LEFT JOIN funnel f ON s.month = f.month
ORDER BY s.month
"""


def monthly_product_metrics_sql(spark: SparkSession, t: Tables, p: Params, prefix: str = "bl_") -> DataFrame:
    t.register(prefix)
    return spark.sql(
        MONTHLY_PRODUCT_METRICS.format(prefix=prefix),
        args={
            "status": p.completed_status,
            "start_date": p.start_date,
            "end_date": p.end_date,
            "top_event": p.top_funnel_event,
            "conversion_event": p.conversion_event,
        },
    )
