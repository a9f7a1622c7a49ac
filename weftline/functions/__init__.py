"""weftline.functions."""
