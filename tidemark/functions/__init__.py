"""Codecs and filters as column expressions."""
