"""Operators on corpora for training language models. Nothing outside this subpackage imports it."""
