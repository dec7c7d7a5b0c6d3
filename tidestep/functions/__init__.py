"""Part of tidestep."""
