"""Operators for preparing training data: text clean-up, duplicates, language, packing, search and archives."""
