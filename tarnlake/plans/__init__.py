"""Composed plans: recall, remember, reflect, forget, and the registered queries."""
