"""The registered queries: every operator on the driver tables, with its SQL equivalent."""

from suite import events, formulas, generated, letters, recorded, streams  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
