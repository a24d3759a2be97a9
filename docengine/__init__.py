"""docengine: document search, chunking, retrieval and evaluation on PySpark DataFrames."""
