"""The same checks over streams."""
