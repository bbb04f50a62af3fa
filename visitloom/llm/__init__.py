"""Operators for building language-model training corpora. Nothing outside this folder imports it."""
