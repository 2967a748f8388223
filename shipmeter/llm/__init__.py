"""Operators on text corpora: near-duplicates, secrets, language, personal data,
toxicity, fingerprints, quality, contamination, token counts and BPE.

Nothing else in the library imports this subpackage.
"""
