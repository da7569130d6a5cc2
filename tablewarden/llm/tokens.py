"""Token ids of public tokenizers, one lookup per run of non-white characters.

A byte-pair tokenizer whose pre-tokenizer never joins characters across a word boundary can be applied to each
space-separated piece of a text on its own. Distinct pieces are encoded once per Python worker and remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Remembered pieces of one worker; when they are full they are forgotten and gathered anew.
REMEMBERED = 300_000


def public_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """Values by piece. ``fill`` looks all pieces of some texts up at once and computes those that are new."""

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit = compute, limit

    def fill(self, pieces: Iterable[str]) -> None:
        wanted = set(pieces)
        new = list(wanted.difference(self))
        if not new:
            return
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(wanted)
        self.update(zip(new, self.compute(new)))
