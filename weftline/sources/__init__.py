"""weftline.sources."""
