"""mapframe: map-extract queries and training-data operators as PySpark DataFrames."""
