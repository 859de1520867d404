"""ragtab.operators."""
