"""reportlake: analytics over append-only value-report streams, built on Spark DataFrames.

Every operator is a plain function ``DataFrame(s) + parameters -> DataFrame``: lazy, no ``collect``,
no session configuration side effects, wall-clock time (``now_ms``) always an explicit argument.
"""

__version__ = "0.1.0"
