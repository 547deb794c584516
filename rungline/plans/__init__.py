"""Whole-program questions composed of the operators."""
