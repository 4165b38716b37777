"""Click statistics over streams."""
