"""DataFrame operators: preparation, candidates, fitting, scoring, swarm, selection."""
