"""Configurations, files and archives that gazetteers are built from."""
