"""groundspark sources."""
