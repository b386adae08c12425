"""Whole plans: the report catalog, its SQL counterpart and the dashboard bundle."""
