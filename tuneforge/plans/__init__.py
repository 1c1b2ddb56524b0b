"""Search drivers (grid, random, particle swarm), the estimator registry and the facade."""
