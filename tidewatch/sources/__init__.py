"""Readers and writers for event, log and report tables."""
