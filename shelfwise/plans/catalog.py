"""All registered queries."""

from shelfwise.plans import views  # noqa: F401
from shelfwise.plans import (  # noqa: F401
    q_quality,
    q_basic,
    q_aggregate,
    q_series,
    q_revenue,
    q_assortment,
    q_commerce,
    q_fulfilment,
    q_forecast,
)
from shelfwise.plans.registry import QUERIES  # noqa: F401
