"""Named retrievers, experiments, sweeps and the registered queries."""
