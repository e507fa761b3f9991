"""Readers, samples and catalog views."""
