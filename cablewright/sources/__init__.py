"""Where sites and stored results come from, and where they go."""
