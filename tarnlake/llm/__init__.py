"""Operators for preparing training text. Nothing else in tarnlake imports this subpackage."""
