"""Query catalogue and the nested study plan."""
