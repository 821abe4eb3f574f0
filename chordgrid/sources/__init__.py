"""Image sources, synthetic shapes, loader semantics and checkpoints."""
