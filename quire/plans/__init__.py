"""Registered queries, their oracle SQL, and the staged extraction plan."""
