"""Readers and writers for flow tables, JSON lines, packet captures and reports."""
