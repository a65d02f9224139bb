"""Where public tokenizer files are."""

from __future__ import annotations

import os


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in `folder`, else in $TOKENIZERS_DIR, else of the installed public_tokenizers package."""
    folder = folder or os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
