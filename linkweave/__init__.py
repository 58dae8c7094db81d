"""linkweave: link-graph analytics on Spark DataFrames.

Every public operator takes and returns DataFrames (or Columns); nothing is
collected to the driver and no Python UDF sits in a hot path.
"""

from linkweave.session import checkpoint_dir, get_session, scratch_path

__all__ = ["checkpoint_dir", "get_session", "scratch_path"]
