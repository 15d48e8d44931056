"""quarrylog: metadata-log analytics on PySpark DataFrames."""
