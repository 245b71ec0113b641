"""casegrain: digital-evidence analytics expressed as Spark DataFrames."""
