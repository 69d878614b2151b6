"""All registered queries of the page-layout operators, and their SQL."""

from pagegrid.plans import clusters, detection, layout, routes
from pagegrid.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "clusters", "detection", "layout", "routes"]
