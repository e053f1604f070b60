"""Operators over pages of token vectors and over the index they make."""
