"""Streaming ingestion of events into the weekly panel."""
