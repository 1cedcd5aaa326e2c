"""Operators for preparing language-model training data.

Nothing else in ``phaseframe`` imports this subpackage; removing the folder
leaves the rest of the library intact.
"""
