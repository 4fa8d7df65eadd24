"""Scans of nested documents and pages, and writes by key."""
