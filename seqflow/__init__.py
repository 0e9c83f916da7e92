"""seqflow: ordered sequences, typed reductions, event traces and task graphs as DataFrame plans."""
