"""Operators on bars, scores, returns and orders."""
