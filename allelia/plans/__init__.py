"""Whole runs, their limits, command lines and the registered queries."""
