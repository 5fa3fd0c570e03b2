"""Transaction-risk analytics on tables and streams."""
