"""Training-data operators: thirteen components over `documents`, `pages`, `benchmark`, `embeddings` and `conversations`.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, keeps
state bounded per task and writes intermediate tables only under ``spark.checkpoint.dir`` (a local session
without it has a temporary folder of its own).
"""
