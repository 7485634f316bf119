"""Operators for preparing text at scale; nothing else in the library imports them."""
