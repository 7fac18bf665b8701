"""Statistics functions."""
