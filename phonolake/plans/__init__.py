"""End-to-end jobs, the stand-in views and the query catalogue."""
