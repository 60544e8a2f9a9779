"""Composed plans: the portfolio chain, the query registry and its SQL oracle."""
