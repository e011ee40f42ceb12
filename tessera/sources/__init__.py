"""Reading and writing snapshots and files."""
