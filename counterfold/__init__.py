"""Logged-decision analytics as Spark DataFrame plans.

Every public function takes DataFrames and returns a DataFrame (or a small
dataclass of lazy DataFrames).  Rows are aligned by key, never by position, and
all randomness is a hash of (seed, key), so results do not depend on how the
data is partitioned or on a task being retried.
"""

from counterfold.errors import AnalysisRefused

__all__ = ["AnalysisRefused"]
