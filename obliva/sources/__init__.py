"""Readers, the dataset catalogue, and writers."""
