"""Search for short transients in noisy multi-channel series, as Spark jobs over tables."""
