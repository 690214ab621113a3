"""Readers and writers of calendars, feeds, pages and JSON."""
