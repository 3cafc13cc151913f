"""Continuous loading of engine tables."""
