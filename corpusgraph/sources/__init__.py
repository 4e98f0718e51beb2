"""Readers and writers of the files of a literature pipeline."""
