"""Levels, the label table and the router."""
