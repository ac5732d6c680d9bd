"""Operators for preparing large text corpora; nothing else in the package imports this subpackage."""
