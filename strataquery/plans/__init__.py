"""The search language, its compilation to DataFrame plans, and the query catalogue."""
