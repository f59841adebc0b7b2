"""Training-data operators: packing, extraction, language, search,
near-duplicates, token counts, personal data, encoding, fingerprints and
toxicity.  Nothing else in the library imports this subpackage."""
