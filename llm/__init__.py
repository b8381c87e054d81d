"""Training-data operators: dedup, PII, toxicity, secrets, packing, quality, joins, LM, HTML, decontamination."""
