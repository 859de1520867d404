"""ragtab.functions."""
