"""Column expressions: time buckets, durations, labels."""
