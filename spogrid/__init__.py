"""spogrid: graph-pattern analytics over subject-predicate-object data on PySpark.

Every operator is a function from DataFrames to a DataFrame; Catalyst plans
and AQE re-plans them.  Nothing is collected to the driver.
"""

from spogrid.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
