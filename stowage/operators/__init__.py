"""Catalog, access, usage, audit and content operators."""
