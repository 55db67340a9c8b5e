"""Readers and writers of the files and documents that markings work with."""
