"""ragtab.sources."""
