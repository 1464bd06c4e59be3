"""Readers and writers: EPUB archives, corpus folders, golden sets, reports."""
