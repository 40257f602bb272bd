"""Standing queries over topics as Structured Streaming micro-batches."""
