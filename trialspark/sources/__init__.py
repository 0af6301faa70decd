"""Readers of recordings, configurations, sorter arrays and tables, and writers of results."""
