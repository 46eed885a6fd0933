from tideline.sources.rows import (
    read_csv_rows,
    read_table,
    row_schema,
    stream_csv_rows,
    stream_table,
    write_rows,
)

__all__ = [
    "read_csv_rows", "read_table", "row_schema", "stream_csv_rows", "stream_table", "write_rows",
]
