"""quantgrove: a Spark-first engine for quantised tabular learning."""
