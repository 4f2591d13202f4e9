"""Queries over the driver tables, one module per area."""

from trailsift.cases import dom, records, scalars, traffic, work
from trailsift.cases.base import QUERIES, oracles

__all__ = ["QUERIES", "dom", "oracles", "records", "scalars", "traffic", "work"]
