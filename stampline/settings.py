"""Immutable settings of a run, in seconds. Every operator takes them as an argument; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults of the segmentation and chunking rules.
    chunk: float = 120.0
    overlap: float = 2.0
    chunk_margin: float = 30.0
    silence: float = 0.5
    max_word: float = 2.0
    srt_words: int = 8
    srt_seconds: float = 5.0
    txt_words: int = 12
    txt_seconds: float = 8.0
    itn_words: int = 50

    @property
    def threshold(self) -> float:
        """A file longer than this is read in chunks."""
        return self.chunk + self.chunk_margin


DEFAULT = Settings()
