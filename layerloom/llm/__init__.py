"""Training-data operators: decontamination, token counts, mixing, dedup, quality, URLs, fingerprints, id files, joins, language models."""
