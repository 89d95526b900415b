"""Queries over the sample tables that exercise every operator, with SQL to check them."""
