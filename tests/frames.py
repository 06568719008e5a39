"""Tiny hand-made input frames for edge-case tests."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from basketlens.params import Params
from basketlens.sources.tables import Tables

ITEM_SCHEMA = (
    "id long, order_id long, user_id long, status string, created_at timestamp_ntz, "
    "returned_at timestamp_ntz, sale_price decimal(18,4)"
)
EVENT_SCHEMA = "user_id long, created_at timestamp_ntz, event_type string"
USER_SCHEMA = "id long, traffic_source string"


def item(order_id, user_id, ts, price, status="Complete", returned=None, item_id=1):
    return (item_id, order_id, user_id, status, ts, returned, Decimal(str(price)))


def tables(spark, items, events=(), users=()):
    return Tables(
        order_items=spark.createDataFrame(list(items), ITEM_SCHEMA),
        events=spark.createDataFrame(list(events), EVENT_SCHEMA),
        users=spark.createDataFrame(list(users), USER_SCHEMA),
    )


def params(**kw) -> Params:
    base = dict(
        start_date=date(2020, 1, 1),
        end_date=date(2020, 12, 31),
        pre_start=date(2020, 3, 1),
        launch_date=date(2020, 3, 15),
        post_end=date(2020, 3, 31),
    )
    base.update(kw)
    return Params(**base)


def ts(*a) -> datetime:
    return datetime(*a)
