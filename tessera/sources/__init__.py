"""Readers and writers of interval, symbol and report text."""
