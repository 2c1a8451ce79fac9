"""Training-data operators: token counts, language, duplicates, scores, clean-up."""
