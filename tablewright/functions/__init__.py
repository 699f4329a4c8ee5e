"""Column-level helpers: text trimming and number tests, masking, date patterns."""

from tablewright.functions.masking import fnv1a64, mask, mask_email
from tablewright.functions.text import java_pattern, looks_numeric, strip, tag_name

__all__ = ["fnv1a64", "java_pattern", "looks_numeric", "mask", "mask_email", "strip", "tag_name"]
