"""Registered queries over the driver tables (one or more per operator ID of the survey)."""

from canopy.plans.registry import ORACLE, QUERIES  # noqa: F401
from canopy.plans import admin, dataops, hier, logs, scalars, storage, workload  # noqa: F401  (registers on import)


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLE)
