"""Scalar functions, as Columns and in SQL."""

from eventide.functions.scalar import get_age, normalize_name, register, unix_time

__all__ = ["get_age", "normalize_name", "register", "unix_time"]
