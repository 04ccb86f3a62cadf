"""Intermediate tables in the folder that the cluster shares."""

from traceloom.store import drop_table, new_path, read_table, save_table, shared_dir, write_table

__all__ = ["drop_table", "new_path", "read_table", "save_table", "shared_dir", "write_table"]
