"""A Spark-first engine for catalogue feed deltas: scan, normalise, fingerprint, diff, guard, merge."""
