"""Readers that normalise traffic logs into observations."""
