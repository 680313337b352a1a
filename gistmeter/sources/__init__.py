"""Reading tables, logs and file listings; writing keyed tables."""
