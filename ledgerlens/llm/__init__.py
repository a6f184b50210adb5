"""Training-data operators: mixing, quality, near-duplicates, media, URLs, tokens, lines, licences, neighbours.

Nothing outside this subpackage imports it.
"""
