"""Readers and writers for keyword files, page corpora and the analytics tables."""
