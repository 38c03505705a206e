"""Readers of delimited data sets, case bases over the driver tables, and sinks."""
