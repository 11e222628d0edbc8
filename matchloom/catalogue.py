"""Every registered query of the schema-matching engine, and its SQL."""

from matchloom.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
