"""Operators for preparing training corpora: extraction, scoring, deduplication, packing and storage formats."""
