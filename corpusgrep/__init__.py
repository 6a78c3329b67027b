"""Regular-expression search over large corpora, planned as Spark DataFrames."""
