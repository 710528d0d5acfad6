"""Empty on purpose: every input of this library is a batch, and no operator keeps state between batches."""
