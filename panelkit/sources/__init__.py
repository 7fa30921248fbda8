"""Sources and sinks: explicit-schema CSV / JSON / text readers, parquet
tables, per-group and report writers."""

from .readers import (read_csv, read_csv_skip_preamble, read_json_records, read_table,  # noqa: F401
                      read_text_files)
from .sinks import write_csv, write_json, write_per_group, write_report, write_table  # noqa: F401
