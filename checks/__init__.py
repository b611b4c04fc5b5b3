"""Registered queries, the views they read and the SQL they are checked against."""
