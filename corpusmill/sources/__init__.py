"""Readers and writers: files, text extraction, evaluation sets, portable bundles."""
