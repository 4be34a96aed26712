"""All named queries: importing the modules registers them."""

from lagline.plans import build_queries, forecast_queries, history_queries, live_queries, signal_queries, stream_queries, trip_queries  # noqa: F401
from lagline.plans.registry import ORACLES, QUERIES  # noqa: F401
