"""Operators for corpora that train language models. Nothing outside this subpackage imports it."""
