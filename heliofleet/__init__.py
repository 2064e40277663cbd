"""Fleet energy analytics as Spark DataFrame jobs.

Every table carries ``site_id``; a single installation is a fleet of one.
Operators take and return DataFrames and never trigger an action on their own.
"""

__version__ = "0.1.0"
