"""Archives, text tables and publications."""
