"""Every catalogue query by name, with its SQL twin where SQL can express it."""

from . import gallery, headers, kept, perceptual, streams, summaries, upkeep

QUERIES: dict = {}
ORACLES: dict = {}
for _book in (gallery.book, summaries.book, upkeep.book, perceptual.book, headers.book, streams.book, kept.book):
    QUERIES |= _book.queries
    ORACLES |= _book.oracles
