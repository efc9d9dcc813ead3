"""Registered queries by area. Importing the modules fills the registry."""

from tallyloom.plans.queries.registry import ORACLES, QUERIES, SURVEY  # noqa: F401
from tallyloom.plans.queries import checks, leaderboards, scoring, storage, tables  # noqa: F401
