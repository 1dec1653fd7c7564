"""Millrace: a compact SQL SELECT dialect over Parquet, lowered to Spark DataFrames."""
