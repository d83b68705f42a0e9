"""Imports every operator module, so that its queries are registered."""

from showgrid.llm import (  # noqa: F401
    debruijn,
    maxsketch,
    mixing,
    ngrams,
    pieces,
    pii,
    quality,
    secrets,
    spotnear,
    suffixes,
    tokenfiles,
    vectors,
    whitening,
)
