"""Column functions: planar geometry, projection, catalogue and tariff rules."""
