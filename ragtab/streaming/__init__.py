"""ragtab.streaming."""
