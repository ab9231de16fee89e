"""Quernel: a Spark-first engine for import, derivation and analytic queries.

Sub-packages
------------
sources    raw-upload registration, import, write-once and partition sinks
operators  reports, track products, joins, windows and aggregates
functions  column expressions shared by the operators
plans      the query catalogue (Spark callables and their SQL counterparts)
streaming  Structured Streaming operators
"""

from quernel.session import build_session

__all__ = ["build_session"]
