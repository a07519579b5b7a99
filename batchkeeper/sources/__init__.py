"""Readers for raw batches and writers for the tables built from them."""
