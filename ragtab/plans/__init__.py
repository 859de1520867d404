"""ragtab.plans."""
