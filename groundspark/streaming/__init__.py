"""groundspark streaming."""
