"""Listings, schemas, tables and files: reading and writing."""
