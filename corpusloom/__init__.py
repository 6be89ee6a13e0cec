"""Corpus inventory analytics on Spark: scans, signals, labels, roll-ups and size-capped samples as DataFrame plans."""
