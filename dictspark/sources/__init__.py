"""Where dictionaries come from."""

from dictspark.sources.affdic import parse_rules, parse_words
from dictspark.sources.dictionary import Dictionary
from dictspark.sources.lines import misspellings_of, parsed_lines, read_words

__all__ = ["Dictionary", "misspellings_of", "parse_rules", "parse_words", "parsed_lines", "read_words"]
