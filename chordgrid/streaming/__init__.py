"""Running metrics over batches of images."""
