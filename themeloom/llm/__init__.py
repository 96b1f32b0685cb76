"""Operators for preparing training data; nothing else in the package imports them."""

from themeloom.llm import (  # noqa: F401
    brown_lm,
    decontaminate,
    language_id,
    packing,
    passages,
    personal,
    quality,
    sharding,
    simhash_dedup,
    spelling,
    token_count,
    transport_stream,
    whitening,
)
from themeloom.llm.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
