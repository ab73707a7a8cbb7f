"""Whole requests, built from the operators."""
