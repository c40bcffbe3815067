"""Operators for large text collections: one module for each, ``queries`` registers them."""
