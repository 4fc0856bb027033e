"""Loaders, sinks and the binding of the test tables."""
