"""Field harmonisation on Spark: bring the columns of many systems onto one vocabulary."""
