"""Preset feature plans and end-to-end jobs."""
