"""veilspark: find, redact, restore, audit and profile sensitive text with Spark DataFrames."""
