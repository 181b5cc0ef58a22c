"""Event logs: ordered folds and windows, in batch and as streams."""
