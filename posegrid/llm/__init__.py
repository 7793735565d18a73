"""Operators for training-data pipelines. Nothing outside this folder imports it.

Each module ``opNN_*`` holds one operator with a general interface; ``queries`` has the thin
queries over the driver's tables and ``oracles`` their SQL.
"""
