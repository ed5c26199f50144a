"""The keyed folds on streams."""
