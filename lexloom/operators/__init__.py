"""Operators over documents: features, profiles, validation, narratives."""
