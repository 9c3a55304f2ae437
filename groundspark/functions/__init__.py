"""groundspark functions."""
