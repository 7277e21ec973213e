"""All registered queries of this subpackage."""

from colloquy.llm import (  # noqa: F401
    chat, convtrie, decontam, linededup, lmscore, mixing, ngramjoin, pii, quality, simhash, toxicity, warc, whitening,
)
from colloquy.llm.registry import ORACLES, QUERIES  # noqa: F401
