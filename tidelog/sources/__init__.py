"""Where log rows come from and go to."""
