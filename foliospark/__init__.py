"""foliospark: corpus, retrieval and evaluation analytics on PySpark.

Everything takes and returns DataFrames or Columns; actions are left to the
caller except where an operator is iterative.
"""

from foliospark.session import get_spark

__all__ = ["get_spark"]
__version__ = "0.1.0"
