"""Readers of the data services' file formats."""
