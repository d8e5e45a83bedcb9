"""tidewatch: content-moderation analytics as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns DataFrames
(or Columns).  Batch and Structured Streaming share the same functions.
"""

__version__ = "0.1.0"
