from tidebin.sources.files import (
    IDENTITY_COLUMN,
    read_interval_csv,
    read_json_array,
    read_json_records,
    read_object_csv,
    parse_json_records,
    write_interval_csv,
    write_interval_table,
)

__all__ = [
    "IDENTITY_COLUMN",
    "parse_json_records",
    "read_interval_csv",
    "read_json_array",
    "read_json_records",
    "read_object_csv",
    "write_interval_csv",
    "write_interval_table",
]
