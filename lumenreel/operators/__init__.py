"""DataFrame operators: predicates, relational shapes, snapshot changes, entity resolution, merging, jobs."""
