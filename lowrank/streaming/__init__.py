"""Structured Streaming pieces.

The original job has no streaming operators (no windows, watermarks or
state).  The one thing that maps is its bulk conversion of a folder of text
matrices into the row container; here that is an incremental file stream
(``convert``) that a scheduler can re-run: each run converts the files that
arrived since the last one, exactly once, tracked in a checkpoint under the
cluster's shared ``spark.checkpoint.dir``.
"""

from .convert import coo_folder_to_parquet, dense_folder_to_parquet

__all__ = ["coo_folder_to_parquet", "dense_folder_to_parquet"]
