"""Operators on tables of words and dictionaries."""

from dictspark.operators.affix import hypotheses, stripped
from dictspark.operators.compound import compounds
from dictspark.operators.correct import slips, suggestions
from dictspark.operators.expand import expanded
from dictspark.operators.lookup import checked, readings
from dictspark.operators.probe import has_flag, homonyms
from dictspark.operators.similar import alike, nearest_roots

__all__ = ["alike", "checked", "compounds", "expanded", "has_flag", "homonyms", "hypotheses", "nearest_roots", "readings", "slips", "stripped", "suggestions"]
