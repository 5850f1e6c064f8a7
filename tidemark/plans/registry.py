"""Queries over the given tables by name, each with its SQL where SQL can say it."""

from tidemark.plans import datasets, evaluation, layers, matching, outlines, rasters, selection, splits

_PLANS = (matching, selection, evaluation, splits, rasters, datasets, layers, outlines)

QUERIES: dict = {}
ORACLES: dict = {}
for _plan in _PLANS:
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
