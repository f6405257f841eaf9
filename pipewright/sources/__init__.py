"""Readers and writers of territories, road data and planned networks."""
