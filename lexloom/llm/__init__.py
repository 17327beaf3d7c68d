"""Operators for preparing training data: packing, quality, duplicates, sketches, mixing, licences and languages."""
