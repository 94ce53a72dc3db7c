"""Registered queries and report jobs."""
