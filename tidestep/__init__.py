"""tidestep: bulk-synchronous supersteps, collectives and messages as Spark DataFrame plans."""
