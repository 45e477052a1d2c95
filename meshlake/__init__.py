"""Mesh traffic analytics as plain Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; ``now`` is always an
argument, nothing is collected to the driver and nothing is cached implicitly.
"""

__version__ = "0.1.0"
