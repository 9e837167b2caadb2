"""Training-data operators: dedup, decontamination, token output, language ID, counts, pieces, WARC, HTML, joins."""
