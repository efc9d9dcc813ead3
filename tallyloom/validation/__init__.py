"""Checks that return violations as rows instead of raising at the first bad one."""
