"""Operators for building training data: duplicates, boilerplate, residue, packing, leakage, encodings."""
