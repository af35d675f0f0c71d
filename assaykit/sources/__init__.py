"""Readers and writers of the domain's formats."""
