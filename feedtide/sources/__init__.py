"""Scans and parsing of landed feed documents."""
