"""Where observations come from and where they are written."""
