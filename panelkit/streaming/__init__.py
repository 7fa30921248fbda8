"""Incremental runs of the batch operators over newly arriving files.

The analysed project has no streaming semantics (no windows, watermarks or
state); this adapter only lets the same DataFrame functions process files as
they land, with Structured Streaming's file source, exactly-once
``foreachBatch`` and a checkpoint in the shared checkpoint folder."""

from .incremental import run_incremental  # noqa: F401
