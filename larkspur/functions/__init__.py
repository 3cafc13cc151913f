"""Scalar functions and the dialect's older semantics, as Column expressions."""
