"""How operators run: prefix aggregates, bounded windows, ordered folds."""
