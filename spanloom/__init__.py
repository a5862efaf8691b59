"""Typed, positioned entities from free text, as DataFrame plans."""
