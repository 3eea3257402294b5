"""The corpus queries by name, with their SQL twins."""

from . import ann, bpe, chat, dedup, html, itq, langid, negatives, packing, periodic, private, quality, substrings

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (dedup, html, itq, langid, substrings, ann, bpe, packing, chat, quality, private, periodic, negatives):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
