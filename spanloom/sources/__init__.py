"""Gazetteers, corpora and sinks."""
