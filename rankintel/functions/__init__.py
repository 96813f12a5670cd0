"""Column-level building blocks: urls, texts, labels and JSON-LD."""
