"""Training-data operators: everything a large text corpus passes through before training."""
