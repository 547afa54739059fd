"""Operators for preparing large text corpora; nothing else in taleloom imports them."""
