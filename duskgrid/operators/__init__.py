"""DataFrame-to-DataFrame operators of the reliability library."""
