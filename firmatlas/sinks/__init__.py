"""Writers: table snapshots and CSV reports."""
