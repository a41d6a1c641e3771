"""Scalar functions and small expression builders."""
