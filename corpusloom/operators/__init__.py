"""Compressors and analyses as DataFrame transformations."""
