"""Release-drift analytics on Spark: scans, snapshot diffs, message templates, weights and repair mining as DataFrame operators."""
