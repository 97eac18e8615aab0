"""Report plans: the dated marts, the access matrix, table upkeep, the daily run."""
