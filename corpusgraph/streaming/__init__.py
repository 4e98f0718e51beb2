"""Tables that grow, read as streams."""
