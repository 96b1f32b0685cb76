"""Registered queries over the driver tables."""

from themeloom.catalog import chats, jobs, models, sets, stores, texts  # noqa: F401
from themeloom.catalog.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
