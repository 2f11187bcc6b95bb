"""End-to-end plans made of functions and operators."""
