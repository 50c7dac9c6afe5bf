"""Readers, sinks and the binding views over the driver tables."""
