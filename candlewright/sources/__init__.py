"""Inputs: bar views over the tables, readers, writers and synthetic series."""
