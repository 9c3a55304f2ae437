"""groundspark plans."""
