"""Scalar functions of bibliographic fields, as column expressions; query-term forms as Python functions."""
