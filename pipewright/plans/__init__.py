"""Registered queries over the driver's tables, their SQL, and the planner."""
