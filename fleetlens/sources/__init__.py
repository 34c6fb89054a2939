"""Readers, table sinks and the run manifest."""
