"""Inspection of territories as they are dropped into a folder."""
