"""Whole runs, and the bindings of the engine to the driver tables."""
