"""Real-time commerce analytics on Spark: layered datasets, wide tables, windowed statistics and dashboard queries."""
