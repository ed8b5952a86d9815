"""Operators for preparing training corpora: language ID, near-duplicates, licences, secrets, tokens, lines, leaks, packing, binary output, media."""
