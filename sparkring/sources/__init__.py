"""Where edges come from, and where they go."""
