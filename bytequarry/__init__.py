"""Analytics over collections of binary assets and their metadata, on PySpark DataFrames."""
