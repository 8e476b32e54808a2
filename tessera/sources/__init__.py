"""Tables on disk with the statistics of their tiles."""
