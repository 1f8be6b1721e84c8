"""Sessions of questions, as batches and as streams."""
