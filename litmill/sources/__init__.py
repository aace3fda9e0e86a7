"""Readers and writers: JSON lines, key-record caches, XML, CSV, and tables replaced as a whole."""

from litmill.sources.readers import read_cache, read_json_lines, read_ledger, read_table, read_xml
from litmill.sources.writers import Report, replace_table, write_audit, write_json_lines

__all__ = ["Report", "read_cache", "read_json_lines", "read_ledger", "read_table", "read_xml", "replace_table", "write_audit", "write_json_lines"]
