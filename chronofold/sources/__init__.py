"""Readers and writers of framed log files."""
