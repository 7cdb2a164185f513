"""DataFrame operators: records, influence, rank, pairs, metrics, judging, hooks, upsert."""
