"""Registered queries, their oracle SQL and the fixture tables they share."""
