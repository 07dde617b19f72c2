"""Whole paths made of operators."""
