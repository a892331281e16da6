"""foliospark: document-evidence analytics on PySpark DataFrames."""
