"""Scalar functions of the library: from columns to columns, all built-in expressions."""
