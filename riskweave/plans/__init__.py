"""Domain plans: features, scoring, explanation, governance, retrieval."""
