"""Readers for registry extracts, filing payloads, filing texts and exported reports."""
