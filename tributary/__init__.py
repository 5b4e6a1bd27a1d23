"""tributary: field lineage, impact analysis and derived-column recomputation on Spark."""
