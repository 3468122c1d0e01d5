"""Part of foliospark."""
