"""Registered queries over the driver tables, each with its SQL counterpart."""

from landloom.catalogue import features, files, landuse, scalars, terrain  # noqa: F401
from landloom.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
