"""Whole workloads, and tables made of the given ones for them."""
