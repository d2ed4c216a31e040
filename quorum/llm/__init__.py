"""Operators for building training corpora on Spark.

Each module holds one operator with its own general interface; ``catalog``
registers the thin queries over the driver tables. Nothing outside this
subpackage imports it.
"""
