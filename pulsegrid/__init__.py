"""Signal, image and training-data analytics on PySpark DataFrames."""
