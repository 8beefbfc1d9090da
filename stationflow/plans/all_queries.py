"""Imports every query module so that each registers its queries."""

from stationflow.plans import obs_queries  # noqa: F401
from stationflow.plans import rule_queries  # noqa: F401
from stationflow.plans import feature_queries  # noqa: F401
from stationflow.plans import metric_queries  # noqa: F401
from stationflow.plans import model_queries  # noqa: F401
from stationflow.plans import source_queries  # noqa: F401
from stationflow.plans import stream_queries  # noqa: F401
from stationflow.plans import report_queries  # noqa: F401
from stationflow.plans import more_queries  # noqa: F401
from stationflow.plans import tree_queries  # noqa: F401
from stationflow.plans import band_queries  # noqa: F401
