"""Code-evidence analytics on Spark: facts are tables, analyses are DataFrame operators."""
