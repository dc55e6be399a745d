"""Training-data operators: chat records, near copies, benchmarks, tokens, quality, toxicity, mixing."""
