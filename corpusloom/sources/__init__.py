"""Readers and writers of records, lists, registries and folders."""
