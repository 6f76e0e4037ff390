"""Operations for building language-model training data, each usable alone.

Nothing outside this subpackage imports it.
"""
