"""Where text and cached examples come from and go to."""
