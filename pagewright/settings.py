"""Options of a conversion, with presets. Unknown keys of stored options are ignored."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Format:
    font: str = "DejaVu Sans"
    font_size: float = 13.0
    line_spacing: float = 1.6
    paragraph_spacing: float = 14.0
    letter_spacing: float = 0.0
    word_spacing: float = 1.5
    reading_width: float = 15.0
    bold_word_start: bool = False
    bold_amount: str = "auto"
    remove_headers_footers: bool = True
    move_citations: bool = False
    move_footnotes: bool = True
    show_decorative_images: bool = False
    ocr_language: str = "auto"
    ocr_correction: str = "review"
    ocr_confidence_threshold: float = 0.9
    about_note: bool = True
    ink_saving: bool = False

    def with_(self, **changes) -> Format:
        return replace(self, **changes)

    def stored(self) -> dict:
        return asdict(self)

    @classmethod
    def from_stored(cls, data: dict) -> Format:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})


PRESETS = {
    "Standard": Format(),
    "Spacious": Format(font_size=14.0, line_spacing=1.8, paragraph_spacing=18.0, word_spacing=2.5, letter_spacing=0.3, reading_width=13.0),
    "High Readability": Format(
        font="Atkinson Hyperlegible", font_size=15.0, line_spacing=2.0, paragraph_spacing=20.0, word_spacing=3.0, letter_spacing=0.6, reading_width=12.0, bold_word_start=True
    ),
    "Compact print": Format(font_size=11.5, line_spacing=1.45, paragraph_spacing=9.0, word_spacing=0.8, reading_width=16.0, ink_saving=True),
}
