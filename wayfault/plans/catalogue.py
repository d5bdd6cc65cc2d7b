"""Imports every module that registers queries."""

from wayfault.plans import events_queries  # noqa: F401
from wayfault.plans import lrs_queries  # noqa: F401
from wayfault.plans import matching_queries, more_queries, network_queries, output_queries, scalar_queries  # noqa: F401
