"""DataFrame-to-DataFrame operators of the registry."""
