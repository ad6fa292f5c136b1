"""Scans and sinks."""

from staylens.sources.files import (create_tables, key_scan, load_raw, read_raw_csv, read_table, save_csv,
                                    save_table, with_row_pos, write_table)
from staylens.sources.fixtures import raw_encounters, raw_encounters_text

__all__ = ["create_tables", "key_scan", "load_raw", "raw_encounters", "raw_encounters_text", "read_raw_csv",
           "read_table", "save_csv", "save_table", "with_row_pos", "write_table"]
