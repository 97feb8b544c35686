"""Context retrieval, its evaluation and its usage statistics on PySpark DataFrames."""
