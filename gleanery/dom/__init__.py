"""HTML trees, selectors and what is read from them, inside one Python worker call."""
