"""Ready-made queries: each operator over the driver's tables, with an equal SQL text where one exists."""

from billweave.plans import evaluation, intake, matching, parsing, posting, reviewing, streams
from billweave.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "evaluation", "intake", "matching", "parsing", "posting", "reviewing", "streams"]
