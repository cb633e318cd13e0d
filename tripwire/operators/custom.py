"""Extension examples: a detector of column expressions, and one in plain Python.

``custom_detector`` is the documented way to add a detector (a substring test
that raises a HIGH ``CUSTOM_DETECTION`` finding).  ``homoglyph_detector`` needs
Python: it asks the Unicode database whether a word mixes Latin letters with
look-alikes of another script.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwire.operators.detectors import finding
from tripwire.operators.scan import python_detector

CUSTOM_NEEDLE = "suspicious_pattern"


def custom_detector(text: Column, needle: str = CUSTOM_NEEDLE) -> Column:
    return F.array_compact(F.array(F.when(text.contains(needle), finding(
        "HIGH", "CUSTOM_DETECTION", F.lit("Custom pattern found.")))))


def mixed_scripts(text: str):
    import unicodedata
    for word in text.split():
        scripts = {unicodedata.name(c, "?").split(" ")[0] for c in word if c.isalpha()}
        if len(scripts & {"LATIN", "CYRILLIC", "GREEK"}) > 1:
            yield "HIGH", "MIXED_SCRIPT", f"Word of mixed scripts: {word}", ""
            return


homoglyph_detector = python_detector(mixed_scripts)
