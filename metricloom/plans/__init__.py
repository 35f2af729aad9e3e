"""Operators put together: the registered queries and the run from sources to narratives."""
