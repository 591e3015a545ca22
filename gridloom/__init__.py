"""Form-page tables, their scoring and their job store, on Spark DataFrames."""
