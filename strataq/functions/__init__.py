"""Scalar functions: hashes, text, time, JSON, vectors, and the user-defined function registry."""
