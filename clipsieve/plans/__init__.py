"""Compositions of operators: the rating flow, presets and the driver-table views."""
