"""Operators for building language-model training corpora. Nothing else in corrobix imports this."""
