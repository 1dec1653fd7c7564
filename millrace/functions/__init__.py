"""The scalar function library; importing it fills the built-in registry."""

from millrace.functions import convert, dates, numbers, strings
from millrace.functions.registry import BUILT_IN, Arg, Registry, ScalarFunction

__all__ = ["BUILT_IN", "Arg", "Registry", "ScalarFunction", "convert", "dates", "numbers", "strings"]
