"""Readers and writers for tracks, configuration, predictions and labels."""
