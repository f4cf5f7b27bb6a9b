"""Readers and writers of collections: JSON lines, files, archives, remote providers and a data source."""
