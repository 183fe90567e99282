"""Relational, windowed and interval operators over tables of tracks."""
