"""Queries: each operator bound to the driver's tables, with the SQL it is held against."""
