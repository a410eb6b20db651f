"""Customer-review analytics on Spark DataFrames."""

from plaudit.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
