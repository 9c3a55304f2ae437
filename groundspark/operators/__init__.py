"""groundspark operators."""
