"""Reuse of big column expressions.

Building an expression of hundreds of parts takes longer than planning it, and a stream
would build the same ones in every micro-batch. They are kept with the Spark context.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark import SparkContext
from pyspark.sql import Column


def memo(key: Hashable, build: Callable[[], Column]) -> Column:
    context = SparkContext._active_spark_context
    if context is None:  # a remote session has no context to keep things with
        return build()
    kept = context.__dict__.setdefault("_loglake_columns", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]
