"""Readers of project files and the synthetic project over the driver's tables."""
