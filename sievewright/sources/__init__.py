"""Reading tables and writing snapshots."""
