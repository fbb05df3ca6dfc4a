"""Incremental supports from a stream of baskets."""
