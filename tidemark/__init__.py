"""Tidemark: weekly engagement analytics and model-log analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is executed
until the caller writes or collects the result.
"""

__version__ = "0.1.0"
