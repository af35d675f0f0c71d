"""assaykit: chemistry and materials text analytics as Spark DataFrame programs."""
