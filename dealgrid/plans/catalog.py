"""Imports every query module so that the registry is complete."""

from dealgrid.plans.registry import ORACLES, QUERIES  # noqa: F401

AREAS = ("scalars", "fx", "forecast", "sync", "deals", "leads", "renewals", "partners", "quotes", "demand", "competitors", "market", "meetings", "tasks", "sources", "streaming")
for _area in AREAS:
    __import__(f"dealgrid.plans.q_{_area}")
