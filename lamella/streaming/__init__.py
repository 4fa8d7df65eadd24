"""Change propagation as structured streams."""
