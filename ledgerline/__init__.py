"""ledgerline: dated finance marts, an access matrix and table upkeep as plain Spark jobs.

Every public function takes and returns DataFrames (columns for ``functions``);
the physical plan is left to Catalyst and AQE.
"""

__all__ = ["session", "functions", "operators", "sources", "plans"]
