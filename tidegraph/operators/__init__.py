"""Relational operators on posts, reshares, trees, activations and graphs."""
