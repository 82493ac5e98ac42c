"""ringwork: molecular-fingerprint analytics on Spark DataFrames."""
