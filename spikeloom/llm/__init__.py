"""Training-data operators: near-dedup, URL filters, language ID, tokenizers, packing and quality models."""
