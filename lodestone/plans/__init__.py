"""Whole queries: operators put together, and the registry that names them."""
