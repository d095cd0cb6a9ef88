"""DataFrame operators: profile, clean, prep, task, split, train, metrics,
rank, review, charts, report, plus the shared order-dependent helpers."""
