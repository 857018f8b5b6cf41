"""tracehound: retrospective threat hunting over security logs on Spark.

Every public function maps DataFrames to a DataFrame; nothing is
collected to the driver.  See README.md for the layout.
"""

from tracehound.session import get_session

__all__ = ["get_session"]
