"""Operators for preparing text corpora: each module is one operator, `catalogue` holds their queries."""
