"""Readers of raw data sets, the adapter of the driver's tables, and the store of derived data."""
