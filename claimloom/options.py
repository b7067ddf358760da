"""Options of parsing, ingestion and export."""

from __future__ import annotations

from dataclasses import dataclass, field

from claimloom.operators import body, drawings, front


@dataclass(frozen=True)
class Pages:
    """The size of a page, in the units of its words, and whether numbers of lines stay in the columns of front matter."""

    width: float = 612.0
    height: float = 792.0


@dataclass(frozen=True)
class Parse:
    """What parsing needs of a document, and when it fails."""

    pages: Pages = field(default_factory=Pages)
    front: front.Policy = field(default_factory=front.Policy)
    body: body.Policy = field(default_factory=body.Policy)
    sheets: drawings.SheetPolicy = field(default_factory=drawings.SheetPolicy)
    fail_on_missing_fields: bool = False
    fail_on_error: bool = False


@dataclass(frozen=True)
class Export:
    """What a bundle holds besides its manifest."""

    front: bool = True
    body_text: bool = True
    drawings: bool = True
    dpi: int = 200
