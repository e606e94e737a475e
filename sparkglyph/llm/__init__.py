"""Operators for preparing training text at cluster scale; nothing outside imports this package."""
