"""Column expressions: extraction, errors, text cleaning, scores, text similarity, logits."""
