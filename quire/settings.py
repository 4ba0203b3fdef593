"""Settings of a conversion, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.errors import BadSettings


def _one_of(name: str, value: str, of: tuple[str, ...]) -> None:
    if value not in of:
        raise BadSettings(f"{name} is {value!r}, which is none of {', '.join(of)}")


@dataclass(frozen=True)
class Reading:
    """How scanned text is read: which words are flagged, and what is known besides the lexicon."""

    enabled: bool = False
    mode: str = "new"
    least_confidence: float = 0.5
    least_length: int = 2
    vocabulary: tuple[str, ...] = ()
    learned: str | None = None
    keep_learned: bool = False

    def __post_init__(self) -> None:
        _one_of("mode", self.mode, ("new", "legacy"))
        if not 0 <= self.least_confidence <= 1:
            raise BadSettings("least_confidence lies between 0 and 1")
        if self.least_length < 1:
            raise BadSettings("least_length is at least 1")


@dataclass(frozen=True)
class Conversion:
    """What a conversion makes, and what becomes of files that fail."""

    on_error: str = "warn"
    headings: str = "fonts"
    page_markers: str = "comment"
    footnotes: bool = False
    use_profiles: bool = False
    reading: Reading = field(default_factory=Reading)

    def __post_init__(self) -> None:
        _one_of("on_error", self.on_error, ("raise", "warn", "skip"))
        _one_of("headings", self.headings, ("fonts", "none"))
        _one_of("page_markers", self.page_markers, ("comment", "heading", "inline"))
