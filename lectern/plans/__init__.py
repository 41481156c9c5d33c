"""Catalogue of registered queries."""
