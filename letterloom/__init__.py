"""letterloom: mail analytics and enrichment as Spark jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  No operator reads the wall clock: the moment a report is made for is
always the ``as_of`` argument.
"""

from letterloom.session import build_session

__all__ = ["build_session"]
