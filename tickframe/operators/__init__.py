"""DataFrame operators: series, points, range aggregates, downsampling."""
