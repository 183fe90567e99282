"""Stateful scoring of streams of tracked boxes."""
