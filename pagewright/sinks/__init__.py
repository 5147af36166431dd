"""Files written from composed documents."""

from .epub import epub_files
from .files import FORMATS, export

__all__ = ["FORMATS", "epub_files", "export"]
