"""Pull-request and CI analytics as Spark jobs.

Every function takes and returns DataFrames (or Columns) and stays lazy, apart
from model fitting, which has to look at the data.  Rows are keyed by
``(repository, pr_number)`` unless a caller passes other ``keys``.
"""

KEYS = ("repository", "pr_number")

__all__ = ["KEYS"]
