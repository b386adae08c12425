"""Report operators: each takes flat events and filters and returns a lazy DataFrame."""
