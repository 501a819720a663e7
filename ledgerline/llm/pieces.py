"""Cutting a text into the pre-tokens of a SentencePiece BPE model, which can be encoded one by one.

The model writes a space as U+2581 and puts one before the text. If no piece of the vocabulary has U+2581
behind another character, no merge crosses the place before a run of spaces; if none holds a line feed, none
crosses a line feed either. A pre-token is then a run of spaces with the word behind it, or a line feed with
the word behind it. `check` proves both for a model.

A pre-token is named by a key: the run's first space is left out, so the usual key is the bare word.
"""

import re

import sentencepiece

SPACE = "▁"
_GENERAL = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: Longer pre-tokens are rare; they are encoded each time, so that a cache's bytes are bounded by its entries.
LONGEST_CACHED = 64


def check(model: sentencepiece.SentencePieceProcessor) -> None:
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"piece {i} of this model crosses words; its texts can't be cut")


def keys(text: str) -> list[str]:
    """The keys of a text's pre-tokens, in order; an empty text has none."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if text[0] != " " and "  " not in text and " \n" not in text:
        return text.replace("\n", " \n").split(" ")
    return [x[1:] if x[0] == " " else x for x in _GENERAL.findall(" " + text)]


def normal_form(key: str) -> str:
    """The pre-token as the model's merges see it."""
    return key.replace(" ", SPACE) if key[:1] == "\n" else SPACE + key.replace(" ", SPACE)


def library_lengths(model: sentencepiece.SentencePieceProcessor, some: list[str]) -> list[int]:
    """Number of ids of each key, by the library, which always adds one space in front.

    Before a line feed, and alone, that space is an id of its own.
    """
    found = model.encode([k or "\n" for k in some], num_threads=1)
    return [1 if not k else len(ids) - (k[0] == "\n") for k, ids in zip(some, found, strict=True)]
