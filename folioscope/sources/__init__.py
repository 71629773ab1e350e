"""Listings, configuration and file formats the engine reads."""
