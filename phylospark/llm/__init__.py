"""Corpus operators; nothing outside this subpackage imports it."""
