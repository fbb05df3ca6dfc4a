"""Baskets, documents and ratings from files, memory and ordinary tables."""
