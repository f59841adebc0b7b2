"""fareflow: trip-booking analytics as Spark jobs.

Operators take DataFrames and return DataFrames; see ``fareflow.plans.catalog``
for the registered queries and README.md for the design.
"""

__version__ = "0.1.0"
