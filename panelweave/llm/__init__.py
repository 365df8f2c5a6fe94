"""Operators for building training corpora: scans, packing, quality, duplicates, token work, chat logs."""
