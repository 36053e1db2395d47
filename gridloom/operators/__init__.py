"""DataFrame operators on gridded tables, fields and run logs."""
