"""Change events, line-delimited files, and stored tables as sources."""
