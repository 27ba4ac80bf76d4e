"""Registered queries, views they run on, and multi-step jobs."""
