"""Training-data operators: language, quality, duplicates, licences, URLs, HTML, tokens, packing."""
