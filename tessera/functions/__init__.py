"""Scalar functions, format masks and value coercions, as expressions that Catalyst knows."""
