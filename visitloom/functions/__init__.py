"""Part of visitloom; see the README for the map of modules."""
