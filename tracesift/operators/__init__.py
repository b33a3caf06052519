"""Relational operators over traces, surfaces, needles, sessions and facts."""
