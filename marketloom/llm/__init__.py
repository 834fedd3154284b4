"""Operators that prepare training text: mixing, filtering, de-duplication, token counts and encoding."""
