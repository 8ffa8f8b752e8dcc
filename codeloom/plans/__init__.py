"""Query catalogue of the core operators."""
