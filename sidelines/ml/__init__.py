"""Feature recipes, models, metrics, stacking and tuning on MLlib."""
