"""All queries of the engine, by name, and the SQL that says the same."""

from plumbline.plans.oracles import ORACLES
from plumbline.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
