"""Sources and sinks."""
from .index_files import read_index, write_index
from .side_table import append_side_table
from .tables import read_table, records, records_in_place

__all__ = ["read_index", "read_table", "records", "records_in_place", "append_side_table", "write_index"]
